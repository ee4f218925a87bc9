"""Tables that are built once and loaded again: a load-or-build cache in the shared folder."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A single-machine session that names none gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="actlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def content_key(spark: SparkSession, paths: list[str], settings: object) -> str:
    """A name for what is built from these files under these settings: other files, sizes, dates or settings give another."""
    seen = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)  # names only, no content is read
        seen.append(tuple(files.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(path, length, modificationTime))")).first()))
    return hashlib.sha256(json.dumps([paths, seen, settings], sort_keys=True, default=str).encode()).hexdigest()[:24]


class TableCache:
    """Tables under one content_key. A table is written apart and renamed when it is whole, so a lost job leaves no half of one."""

    def __init__(self, spark: SparkSession, paths: list[str], settings: object):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/actlake-cache/{content_key(spark, paths, settings)}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def load_or_build(self, name: str, build: Callable[[], DataFrame], sort: list[str] | None = None) -> DataFrame:
        """The table of this name; built and written first if it isn't there."""
        path = f"{self.folder}/{name}"
        at, files = self._files(path)
        if not files.exists(at):
            own, rows = f"{path}-{uuid.uuid4().hex[:8]}", build()
            (rows.sortWithinPartitions(*sort) if sort else rows).write.option("compression", "zstd").parquet(own)
            part, _ = self._files(own)
            if files.exists(at) or not files.rename(part, at):  # another job was first
                files.delete(part, True)
        return self.spark.read.parquet(path)

    def save(self, df: DataFrame) -> DataFrame:
        """An intermediate table under a name of its own."""
        return self.load_or_build(f"part-{uuid.uuid4().hex}", lambda: df)
