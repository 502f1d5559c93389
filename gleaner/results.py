"""What models said, kept by content: a table on storage from the hash of an input to its result.

Calls to a model are the slowest and dearest step of a plan, so none is made twice.  A result's key is the SHA-256 of
the text or prompt, its folder the model's label; inputs that the table has are left out by an anti-join, equal inputs
are called once.  The rest goes in waves, each appended by one job whose files appear when it commits.  So a job that
is lost after some waves goes on with the others when it is run again, on this cluster or a later one.

Two jobs that fill the same table at once may both call for an input; readers take one row a key.  A null input has no
result.  The label must name everything that decides a result: model, version, settings, instructions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

KEY = "__result_key"


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


class Results:
    """The results of one model: ``label`` names it, ``kind`` is the SQL type of a result."""

    def __init__(self, spark: SparkSession, path: str, label: str, kind: str):
        self.spark, self.label, self.kind = spark, label, kind
        self.path = f"{path.rstrip('/')}/{quote(label, safe='')}"
        self.schema = T._parse_datatype_string(f"key string, run string, value {kind}")

    def rows(self) -> DataFrame:
        """``key, run, value`` of everything stored, read anew."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)

    def known(self) -> DataFrame:
        """``key, value``, one row a key."""
        return self.rows().select("key", "value").dropDuplicates(["key"])

    def missing(self, texts: DataFrame, column: str) -> DataFrame:
        """``key, text`` of the distinct inputs without a result; hashes are compared, each text is shuffled once."""
        asked = texts.where(F.col(column).isNotNull()).select(content_key(F.col(column)).alias("key"), F.col(column).alias("text"))
        return asked.join(self.rows().select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))

    def fill(self, texts: DataFrame, column: str, call: Callable[[list[str]], Sequence[Any]], *, run: str = "", waves: int = 1, concurrency: int | None = None) -> None:
        """Call for every input of ``texts`` that has no result yet, at most ``concurrency`` tasks at once, and keep the results wave by wave."""
        kind = to_arrow_type(T._parse_datatype_string(self.kind))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = list(call(batch.column(1).to_pylist()))
                if len(said) != batch.num_rows:
                    raise ValueError(f"the model gave {len(said)} results for {batch.num_rows} inputs")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([run] * len(said), pa.string()), pa.array(said, kind)], ["key", "run", "value"])

        for wave in range(waves):
            part = texts if waves == 1 else texts.where(F.pmod(F.xxhash64(content_key(F.col(column))), F.lit(waves)) == wave)
            new = self.missing(part, column)
            # Dealt anew, so that the inputs are made by all tasks and only the calls are held back.
            dealt = new.repartition(concurrency) if concurrency else new
            dealt.mapInArrow(ask, self.schema).write.mode("append").option("compression", "zstd").parquet(self.path)

    def joined(self, texts: DataFrame, column: str, name: str) -> DataFrame:
        """``texts`` with the stored result of ``column`` as ``name``, null where there is none."""
        known = self.known().select(F.col("key").alias(KEY), F.col("value").alias(name))
        # The key is a column before the join, so a text that nobody reads afterwards is not shuffled.
        return texts.withColumn("__own_key", content_key(F.col(column))).join(known, F.col("__own_key") == F.col(KEY), "left").drop(KEY, "__own_key")
