"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.operators.spread import HOT, HOT_ROWS, hot_keys, spread_join
from actlake.sources.cache import shared_dir

__all__ = ["ASCII_SPACE", "HOT", "HOT_ROWS", "Workspace", "ascii_lower", "bounded_batches", "held_out", "hot_keys", "packed", "partitions", "shared_dir", "spread_join", "table", "unpacked"]

#: The six characters of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other code point untouched."""
    return F.translate(c, UPPER, UPPER.lower())


class Workspace:
    """Intermediate tables in the shared folder: they cut lineage, and survive lost executors.

    Tables that the returned DataFrame still reads must stay; drop() removes those that are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._workspace_path)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learnt from. A null id is in no fold: False."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Fewer rows in each Arrow batch than Spark's default, as texts may be long: it bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """The named columns, and the whole row as `_row`: whatever a caller's columns are called, they can't clash with an operator's own."""
    return df.select(*(c.alias(name) for name, c in own.items()), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of packed() and the new ones; a column that is named like a new one is replaced, in its place."""
    both = df.select("_row", F.struct(*(c.alias(name) for name, c in new.items())).alias("_new"))  # apart, as an alias may hide a column of its name
    names = [*columns, *(name for name in new if name not in columns)]
    return both.select(*(F.col(f"{'_new' if c in new else '_row'}.`{c}`").alias(c) for c in names))
