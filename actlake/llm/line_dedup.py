"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The store holds sorted runs of (line hash, owner), where the owner is
the smallest doc_id that has the line. Each batch reduces its lines to one row a hash, anti-joins them with every run
and adds what is new as a run of its own. When a level has FANOUT runs they are merged into one run of the next level,
so a batch meets a number of runs that grows with the logarithm of the number of batches.

A run is a table that is bucketed and sorted by the hash, with as many buckets as a shuffle has partitions. So only a
batch is shuffled: it meets all runs, and runs meet each other, by merge joins that neither shuffle nor sort them. A
LineStore in a folder of its own outlives the session: it opens again with its runs, and takes further batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlake.llm.common import HOT, HOT_ROWS, Workspace, bounded_batches, packed, partitions, unpacked

MIN_CHARS, BATCHES, FANOUT = 10, 4, 2
KEY = ["_h1", "_h2"]
_KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def line_hash(line: str) -> bytes | None:
    """128-bit hash of the line's key; None where the key has fewer than MIN_CHARS code points."""
    import xxhash

    stripped = line.strip(" \t\n\x0b\x0c\r")
    return xxhash.xxh3_128_digest(stripped.encode().lower()) if len(stripped) >= MIN_CHARS else None


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {h for line in (text or "").split("\n") if (h := line_hash(line))}
            ids += [doc_id] * len(own)
            hashes.extend(own)
        pairs = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(ids, pa.int64())], names=[*KEY, "_doc"])


class LineStore:
    """Levelled sorted runs in a folder. Every batch's ids must be above those of the batches before."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        # Files of a bucket are single, so a bucket's order can be relied on.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.buckets, self.next = partitions(spark), 0
        self.levels: list[list[tuple[str, DataFrame]]] = []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        known = sorted(x.getPath().getName() for x in self.files.listStatus(path)) if self.files.exists(path) else []
        for name in known:  # run=<number>-<level>-<buckets>
            number, level, self.buckets = map(int, name.removeprefix("run=").split("-"))
            self.next = max(self.next, number + 1)
            if self.files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")):
                self._put(level, name, self._table(name))

    def _table(self, name: str) -> DataFrame:
        table = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} (_h1 BIGINT, _h2 BIGINT, _owner BIGINT) USING parquet CLUSTERED BY (_h1, _h2) SORTED BY (_h1, _h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(table)

    def _put(self, level: int, name: str, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, run))

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"run={self.next:06}-{level}-{self.buckets}"
        self.next += 1
        table = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        self._put(level, name, self.spark.table(table))

    def runs(self) -> list[DataFrame]:
        """Together they hold each hash once, with its owner."""
        return [run for level in self.levels for _, run in level]

    def add(self, lines: DataFrame) -> None:
        """lines: _h1, _h2, _doc of a batch."""
        new = lines.groupBy(*KEY).agg(F.min("_doc").alias("_owner"))
        for run in self.runs():
            new = new.join(run.hint("merge"), KEY, "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            parts, self.levels[level] = self.levels[level], []
            merged = parts[0][1]
            for _, part in parts[1:]:  # no hash is in two runs, so this merges them
                merged = merged.join(part.withColumnRenamed("_owner", "_other").hint("merge"), KEY, "full").select(*KEY, F.coalesce("_owner", "_other").alias("_owner"))
            self._write(merged, level + 1)
            for name, _ in parts:
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)
            level += 1


@F.pandas_udf(_KEPT)
def _kept_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """_drops: both halves of each dropped hash, in turn."""
    for texts, dropped in batches:
        out = []
        for text, drop in zip(texts, dropped):
            lines = (text or "").split("\n")
            kept = lines
            if drop is not None and len(drop):
                raw = np.asarray(drop, dtype="<i8").tobytes()
                gone = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                kept = [x for x in lines if line_hash(x) not in gone]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


_kept_of = _kept_of.asNondeterministic()  # else a filter on its result gets a second worker, which does all again


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Drops lines that a document with a smaller id has as well, and adds n_lines, n_dropped and kept (the text left).

    Lines are parted by \\n; a null or empty text is one empty line. A line's key is the line without ASCII space at
    both ends, A-Z lower-cased; keys under MIN_CHARS code points are never dropped. A key found in several documents
    keeps all its lines in the one with the smallest id. Rows that share an id are one document. A row whose id is
    null takes no part: its lines stay and drop none. Keys are compared by 128-bit hashes. Other columns pass through,
    whatever they are called; columns named n_lines, n_dropped or kept are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "line-dedup")
    bounded_batches(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("_doc")).where("_doc IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("_doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("_doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string")).where("_doc IS NOT NULL").mapInArrow(_line_hashes, "_h1 long, _h2 long, _doc long")
    lines = ws.save(lines.withColumn("_batch", batch), partition_by="_batch")

    store = LineStore(spark, f"{ws.base}/runs")
    for b in range(len(cuts) + 1):
        store.add(lines.where(F.col("_batch") == b))
    # A line of very many documents is met where they are; the others go to the runs.
    limit = max(HOT_ROWS, lines.count() // HOT)
    hot = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("_doc").alias("_owner")).where(F.col("n") > limit).select(*KEY, "_owner").toArrow()  # fewer than HOT
    hot = F.broadcast(spark.createDataFrame(hot))
    found = lines.join(hot, KEY).select("_doc", *KEY, "_owner")
    cold = lines.select(*KEY, "_doc").join(hot, KEY, "left_anti").repartition(store.buckets, *KEY)
    for run in store.runs():
        found = found.unionByName(cold.join(run.hint("merge"), KEY).select("_doc", *KEY, "_owner"))
    drops = found.where("_owner < _doc").groupBy("_doc").agg(F.flatten(F.collect_list(F.array(*KEY))).alias("_drops"))
    rows = packed(docs, _doc=F.col(id_col).cast("long"), _text=F.col(text_col).cast("string")).join(drops, "_doc", "left")
    rows = rows.select("_row", _kept_of("_text", "_drops").alias("_out"))
    return unpacked(rows, docs.columns, **{c: F.col(f"_out.{c}") for c in ("n_lines", "n_dropped", "kept")})


ORACLE_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
keyed AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
kept AS (SELECT doc_id, i, line, coalesce(owner < doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
