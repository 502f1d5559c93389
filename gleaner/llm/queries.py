"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import centroids, chat, decontaminate, langid, line_dedup, near_dedup, packing, pii, quality, repeats, spelling, sql, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl(pages: DataFrame) -> DataFrame:
    """Archive records made from every page by fixed formulas: two full responses and two revisits.

    A third of the second responses and revisits are of one hot URL.  Responses of a page have different
    validators, some the same instant; URLs differ in scheme, user, case, port, fragment, tracking and order of
    parameters.  A revisit comes before, between or after the responses.
    """
    n = F.col("page_id")
    md5 = F.md5(F.coalesce("html", F.lit("")))
    tag = lambda at: F.when(n % 5 != 0, F.concat(F.lit('"'), F.substring(md5, at, 16), F.lit('"')))
    day = lambda cycle, out: F.when(n % out != 0, F.concat(F.lit("day "), (n % cycle).cast("string")))
    at, hot = n * 7919 % 2_592_000, n % 3 == 0
    bare = F.regexp_replace("url", "#.*$", "")
    host, rest = (F.regexp_extract(bare, r"^[a-z]+://([^/?]*)(.*)$", i) for i in (1, 2))
    more = F.concat(F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=mail&gclid="), n.cast("string"))
    other = F.concat(F.lit("HTTP://me@WWW."), F.upper(host), F.lit(":80"), rest, more)
    some = lambda **fields: F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull())
    size = F.length("html")
    full = lambda etag, modified, size: some(ETag=etag, Last_Modified=modified, Content_Type=F.lit("text/html"), Cache_Control=F.lit("max-age=60"), Content_Length=size.cast("string"))
    third = some(
        etag=F.when(n % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.when(n % 2 == 0, tag(17)).otherwise(tag(1)))),
        Last_Modified=F.when(n % 2 == 0, day(31, 4)).otherwise(day(29, 3)), Content_Type=F.lit("none"),
        Cache_Control=F.concat(F.lit("max-age="), (n % 100).cast("string")), Content_Length=F.lit("0"), Age=F.lit("1"),
    )
    fourth = some(Last_Modified=day(29, 3), Date=F.lit("later"))
    record = lambda i, url, ts, kind, headers, digest: F.struct(
        (n * 4 + i).alias("record_id"), url.alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + ts).alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"), digest.alias("digest")
    )
    rows = F.array(
        record(0, F.col("url"), at, "response", full(tag(1), day(29, 3), size), md5),
        record(1, F.when(hot, warc.HOT[0]).otherwise(other), F.when(n % 6 == 1, at).otherwise(at + 700_000 + n % 500_000), "response", full(tag(17), day(31, 4), size + 1), F.md5(md5)),
        record(2, F.concat("url", F.lit("#again")), at + 3600 + n * 104_729 % 2_000_000, "revisit", third, F.lit(None).cast("string")),
        record(3, F.when(hot, warc.HOT[1]).otherwise(F.col("url")), at - 50_000 + n * 31 % 900_000, "revisit", fourth, md5),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl(_table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return found.select(
        "record_id", "canonical_url", "refers_to", "status", F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")).alias("headers")
    )


def op2_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(_table(spark, sf_dir, "documents")))


def op4_bfd_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_matrices(_table(spark, sf_dir, "documents"))


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_recurring_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_paths(chat.reply_paths(chat.chain(turns.unionByName(planted)))))
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_again, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).drop("kept_text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_hierarchically(_table(spark, sf_dir, "documents"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.delta_lloyd(_table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_superminhash_dedup": op2_superminhash_dedup,
    "op3_pii": op3_pii,
    "op4_bfd_matrices": op4_bfd_matrices,
    "op5_winnowing_decontamination": op5_winnowing_decontamination,
    "op6_recurring_passages": op6_recurring_passages,
    "op7_reply_trees": op7_reply_trees,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_hierarchical_packing": op10_hierarchical_packing,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_language_id": op12_language_id,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
