"""Resolution of not-modified revisit records to the latest earlier full response of the same canonical URL.

The as-of join works on instants, not on records: full responses are reduced to one per (URL, instant) and
revisits to their distinct instants, both with map-side combination.  The timeline is cut into blocks of
``block`` seconds; inside a block a window finds the latest earlier response, and one summary row per block
carries the last response over to later blocks.  A block has at most one instant per time unit, so a URL with
a third of all records is spread over its blocks and no window sees more than a block.

The revisit's validators are then compared with that response: entity tags (weakly) when both have one, else
Last-Modified when both have one, else payload digests.  Headers of a confirmed revisit update the stored ones
except those that describe the stored content or one connection only.

Defined cases: a null URL, or a revisit without an earlier response, is ``no_response``; nothing to compare is
``unverified``; of several responses at one instant the largest record id counts; a response at the revisit's
own instant is not earlier; null times are not earlier than anything; repeated records give a row each;
header names are compared in lower case and the last of equal names counts; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a 304 response may not change in a stored response (content and connection fields).
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Query parameters that name a visit and not a page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)"

#: Two ways to write one URL, which the registered query gives to a third of its pages.
HOT = ("http://hot.example.com/list?b=2&a=1", "https://www.HOT.example.com:443/list/?utm_source=x&a=1&b=2")


def canonical_url(url: Column) -> Column:
    """Scheme, user, ``www``, default port, fragment, tracking parameters and closing slash off; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(head, "^.*@", "")), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def lower_names(headers: Column) -> Column:
    """The header map with lower-case names; the last of names that differ in case counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e.key)))
    values = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e.key) == n), -1).value)
    return F.map_from_arrays(names, values)


def resolve_revisits(records: DataFrame, *, block: int = 86_400) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, refers_to, status, headers`` (merged, where confirmed or unverified).

    ``records`` has ``record_id, url, ts, kind`` (``response`` or ``revisit``), ``headers`` map and ``digest``.
    """
    every = records.select(
        "record_id", canonical_url(F.col("url")).alias("canon"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "kind",
        lower_names(F.col("headers")).alias("headers"), F.col("digest").cast("string").alias("digest"),
    )
    cell = F.floor(F.col("t") / F.lit(block * 1_000_000))
    full = every.where("kind = 'response' and canon is not null and t is not null")
    full = full.groupBy("canon", "t").agg(F.max_by(F.struct("record_id", "headers", "digest"), "record_id").alias("f"))
    revisits = every.where("kind = 'revisit'")
    look = revisits.where("canon is not null and t is not null").select("canon", "t").distinct()
    line = full.select("canon", "t", "f", F.lit(False).alias("asked")).unionByName(look.select("canon", "t", F.lit(None).alias("f"), F.lit(True).alias("asked")))
    line = line.select("*", cell.alias("cell"))
    earlier = Window.partitionBy("canon", "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    inside = line.select("canon", "t", "cell", "asked", F.last("f", ignorenulls=True).over(earlier).alias("near")).where("asked")
    last = full.select("canon", cell.alias("cell"), "t", "f").groupBy("canon", "cell").agg(F.max_by("f", "t").alias("f"))
    cells = last.unionByName(look.select("canon", cell.alias("cell"), F.lit(None).alias("f"))).groupBy("canon", "cell").agg(F.first("f", ignorenulls=True).alias("f"))
    over = Window.partitionBy("canon").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("canon", "cell", F.last("f", ignorenulls=True).over(over).alias("far"))
    found = inside.join(carried, ["canon", "cell"], "left").select("canon", "t", F.coalesce("near", "far").alias("f"))
    joined = revisits.join(found, ["canon", "t"], "left")

    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    there = F.col("f.headers")
    match = F.coalesce(
        tag(F.col("headers")) == tag(there), F.col("headers")["last-modified"] == there["last-modified"], F.col("digest") == F.col("f.digest")
    )
    status = (
        F.when(F.col("f").isNull(), "no_response").when(match.isNull(), "unverified").when(match, "not_modified").otherwise("validator_mismatch")
    )
    allowed = F.map_filter("headers", lambda k, _: ~k.isin(NOT_UPDATED))
    merged = F.map_zip_with(there, allowed, lambda _, old, new: F.coalesce(new, old))
    out = joined.select("record_id", F.col("canon").alias("canonical_url"), F.col("f.record_id").alias("refers_to"), status.alias("status"), merged.alias("m"))
    return out.select("record_id", "canonical_url", "refers_to", "status", F.when(F.col("status").isin("not_modified", "unverified"), F.col("m")).alias("headers"))
