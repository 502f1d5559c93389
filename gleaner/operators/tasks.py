"""Task types for which the toolbox defines only a contract, each as a small general operator of our own design."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators.similarity import similarity_groups
from gleaner.session import checkpointed, spread


def aggregate_by_month(df: DataFrame, date: Column) -> DataFrame:
    return df.where(tx.published(date).isNotNull()).groupBy(F.substring(date.cast("string"), 1, 7).alias("month")).agg(F.count("*").alias("n"))


def compare_with_previous(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Each period beside the one before it in its group: previous value, difference, ratio."""
    w = Window.partitionBy(*by).orderBy(period)
    before = F.lag(value).over(w)
    return df.withColumn("previous", before).withColumn("difference", F.col(value) - F.col("previous")).withColumn("ratio", F.col(value) / F.nullif(F.col("previous"), F.lit(0.0)))


def benchmark_percentile(df: DataFrame, peers: Sequence[str], value: str) -> DataFrame:
    """Each row's percentile and distance from the mean among its peers."""
    w = Window.partitionBy(*peers)
    return df.withColumn("percentile", F.percent_rank().over(w.orderBy(value))).withColumn("peer_mean", F.avg(value).over(w)).withColumn("above_mean", F.col(value) - F.col("peer_mean"))


def classify(df: DataFrame, rules: Sequence[tuple[str, Column]], default: str = "other") -> DataFrame:
    """``label`` of the first rule that holds."""
    label = F.lit(default)
    for name, condition in reversed(rules):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return df.withColumn("label", label)


def detect(df: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """One row per match: the detector and its evidence, in order."""
    def matches(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m, i: F.struct(F.lit(name).alias("detector"), i.alias("at"), m.alias("evidence")))

    found = F.concat(*[matches(name, pattern) for name, pattern in patterns.items()])
    return df.select("*", F.explode(found).alias("__d")).select(*df.columns, "__d.*")


def deduplicate_exact(df: DataFrame, text: Column, order: str) -> DataFrame:
    """The first row of each normalised text, with the size of its group; only hashes and ids are shuffled."""
    key = df.select(order, F.sha2(tx.collapse(text), 256).alias("key"))
    groups = key.groupBy("key").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return df.join(groups.drop("key"), order)


def resolve_entities(df: DataFrame, name: str, key: Column) -> DataFrame:
    """Names with one normalised key resolve to the smallest of them."""
    keyed = df.withColumn("__k", key)
    canon = keyed.groupBy("__k").agg(F.min(name).alias("canonical"), F.count_distinct(name).alias("variants"))
    return keyed.join(canon, "__k").drop("__k")


def clean_boilerplate(df: DataFrame, key: str, group: str, text: str, *, least: int, most: int = 4096) -> DataFrame:
    """Texts without the lines that at least ``least`` rows of their group share; ``key`` is unique.

    Rows send one hash for each distinct line.  Up to ``most`` shared lines are looked up where the texts are
    read; more are joined with the lines' hashes and come back as places.  Lines are put together in the row.
    """
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    hashes = F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.col(group), F.trim(x))))
    rows = spread(df.select(key, group, text)).select(key, group, lines.alias("__l"), hashes.alias("__h"))
    each = rows.select(F.explode_outer(F.array_distinct("__h")).alias("h")).where("h is not null")
    common = checkpointed(each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h"))
    few = common.limit(most + 1).collect()
    if len(few) <= most:
        gone = f"coalesce(h in ({', '.join(f'{r.h}L' for r in few)}), false)" if few else "false"
        return rows.select(key, group, F.expr(f"array_join(zip_with(__l, __h, (x, h) -> if({gone}, null, x)), '\n')").alias("text"))
    placed = rows.select(key, F.posexplode("__h").alias("at", "h")).join(common, "h").groupBy(key).agg(F.collect_set("at").alias("__gone"))
    joined = rows.select(key, group, "__l").join(placed, key, "left")
    return joined.select(key, group, F.expr("array_join(transform(__l, (x, i) -> if(array_contains(__gone, i), null, x)), '\n')").alias("text"))


def deduplicate_same_words(df: DataFrame, text: Column, order: str) -> DataFrame:
    """The first row of the texts that have the same distinct words, whatever their order, case and punctuation, with the size of its group."""
    words = F.array_sort(F.array_distinct(tx.tokens(text)))
    keyed = df.select(order, F.sha2(F.array_join(words, " "), 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return df.join(groups.drop("key"), order)


def deduplicate_near(df: DataFrame, text: Column, order: str, *, threshold: float = 0.8) -> DataFrame:
    """The first row of each near-duplicate group, with the size of its group.

    Texts are linked when the Jaccard similarity of their distinct words is ``threshold`` or more, and grouped with
    all that they reach.  ``order`` is unique; texts without words are one group.
    """
    found = similarity_groups(df.select(F.col(order).alias("id"), text.alias("text")), tx.tokens(F.col("text")), F.col("id"), threshold=threshold)
    groups = found.groupBy(F.col("root").alias(order)).agg(F.sum("copies").alias("copies"))
    return df.join(groups, order)


def parse_pages(df: DataFrame, html: str) -> DataFrame:
    """``title``, ``page_lang`` and ``body`` of raw pages: scripts, styles, comments and tags off, blanks collapsed."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
    first = lambda p: F.nullif(F.trim(F.regexp_extract(F.col(html), p, 1)), F.lit(""))
    return df.withColumn("title", first(r"(?is)<title[^>]*>(.*?)</title>")).withColumn("page_lang", first(r"(?i)<html[^>]*\blang=\"([^\"]*)\"")).withColumn("body", body)


def normalize_codes(df: DataFrame, column: str, codes: dict[str, str], default: str = "unknown") -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.lower(F.trim(F.col(column).cast("string")))), F.lit(default)))


def enrich(df: DataFrame, other: DataFrame, on: Column, columns: Sequence[str]) -> DataFrame:
    """Columns of another table where it matches, and whether it did."""
    joined = df.join(other.withColumn("__m", F.lit(True)), on, "left")
    return joined.select(*[df[c] for c in df.columns], *[other[c] for c in columns], F.coalesce("__m", F.lit(False)).alias("matched"))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule, how many rows pass and fail; all rules in one pass over the data."""
    told = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"p{i}") for i, c in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"p{i}").alias("passed"), (F.col("n") - F.col(f"p{i}")).alias("failed")) for i, r in enumerate(rules)])
    return told.select(F.inline(rows))


def mentions(df: DataFrame, text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def select_track(df: DataFrame, pattern: str, title: Column, *fields: Column) -> DataFrame:
    """Rows whose title matches, or whose title and other fields together match at least twice."""
    folded = F.lower(F.concat_ws(" ", title, *fields))
    return df.where(F.lower(F.coalesce(title, F.lit(""))).rlike(pattern) | (F.regexp_count(folded, F.lit(pattern)) >= 2))
