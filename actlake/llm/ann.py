"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by floor((a.x + b) / WIDTH) for HASHES Gaussian directions a. A query visits,
besides its own bucket, buckets that are perturbed by -1 or +1 in some hashes, in the order of their estimated
success: the sum of squared distances to the borders that are crossed. Candidates of all tables are merged and ranked
by their exact inner product. Vectors are brought to one length by a further coordinate first, so that the largest
inner product is the smallest distance. That is done in bands of lengths, each with its own buckets, so that a few long
vectors don't press all others into one bucket. Length 1 is in the middle of a band, so normalised vectors share one.

Probing is good for neighbours of a positive inner product. A query that finds fewer than k of them is compared with
all vectors, so each has k neighbours, or all others if there are fewer.

Equal vectors form one class and are hashed once; of a class only the smallest KEEP ids can be among the nearest.
Buckets are met block by block: a bucket with many vectors or many probing queries is dealt to several groups, so no
group grows with the data, and each group returns only its best few for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import Workspace, hot_keys, spread_join

TABLES, HASHES, WIDTH, PROBES, SEED = 8, 3, 1.2, 12, 5
#: Lengths in a band differ by less than this factor.
BAND = 1.25
#: The bucket of all vectors.
ALL = 1
#: Vectors and queries of a bucket that meet in one group, about.
BLOCK, QUERY_BLOCK = 4_000, 1_000


class PStableHash:
    def __init__(self, dim: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(tables, hashes, dim + 1)) / width
        self.b = rng.random((tables, hashes))
        self.shifts = np.array(list(product((-1, 0, 1), repeat=hashes)))
        self.tables, self.probes = tables, min(probes, len(self.shifts))

    def _place(self, x: np.ndarray, t: int) -> np.ndarray:
        return x @ self.a[t].T + self.b[t]

    @staticmethod
    def _code(cells: np.ndarray, t: int) -> np.ndarray:
        """64-bit bucket keys."""
        acc = np.full(cells.shape[:-1], t + 1, np.uint64)
        for i in range(cells.shape[-1]):
            acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) + cells[..., i].astype(np.int64).astype(np.uint64)
        acc = (acc ^ (acc >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (acc ^ (acc >> np.uint64(29))).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Keys [vector, table]."""
        return np.column_stack([self._code(np.floor(self._place(x, t)), t) for t in range(self.tables)])

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Keys [query, table * probe], a table's in the order of estimated success."""
        out = []
        for t in range(self.tables):
            place = self._place(x, t)
            cell = np.floor(place)
            inside = (place - cell)[:, None, :]
            cost = np.where(self.shifts < 0, inside**2, np.where(self.shifts > 0, (1 - inside) ** 2, 0.0)).sum(axis=2)
            order = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            out.append(self._code(cell[:, None, :] + self.shifts[order], t))
        return np.concatenate(out, axis=1)


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)


def _placed(cids: pa.Array, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """bucket, cid of each key of each row in at."""
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), cids.take(pa.array(np.repeat(at, keys.shape[1])))], names=["bucket", "cid"])


def _unit(x: np.ndarray, length: float) -> np.ndarray:
    """On the unit sphere by a further coordinate, in units of the longest vector."""
    x = x / length
    return np.column_stack((x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))))


def _of_band(keys: np.ndarray, band: int) -> np.ndarray:
    """A band's own keys."""
    return keys ^ np.int64(((band + 20_000) * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _vec (packed doubles) of vectors that aren't null, zero, or with null or non-finite components, nor of another length than most."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), v.cast("array<double>").alias("_v"))
    common = rows.groupBy(F.size("_v").alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    dim = common["_d"] if common else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim) + 0.0
                length = np.sqrt((m * m).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in m], pa.binary()), pa.array(length)], names=["_id", "_vec", "_len"])

    return rows.where(F.size("_v") == dim).mapInArrow(pack, "_id long, _vec binary, _len double")


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that is_query picks, itself left out.

    score is the inner product in double precision on the original vectors; nearest first, ties to the smaller id.
    Each query has k rows, or one for each other vector if there are fewer. Rows that share an id count as one if their
    vectors are equal. Vectors that usable() leaves out take no part, neither as queries. An empty table gives none.
    More tables and probes find more; a narrower width makes buckets smaller. Other columns don't matter.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    keep = k + 1
    asks = vectors.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id")).distinct()
    base = ws.save(usable(vectors, id_col, vector_col).distinct().withColumn("_band", F.round(F.log("_len") / F.log(F.lit(BAND))).cast("int")))
    first = base.select("_vec").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = PStableHash(len(first["_vec"]) // 8, tables, hashes, width, probes)

    # Classes of equal vectors: their smallest ids. The window keeps but `keep` rows a partition before it shuffles.
    ranked = base.withColumn("_n", F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))).where(F.col("_n") <= keep)
    classes = ws.save(ranked.groupBy("_vec", "_band", "_len").agg(F.sort_array(F.collect_list("_id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)))
    # Queries that share one vector are dealt to several tasks, here and where they get their lists.
    shared = hot_keys(base.groupBy("_vec").agg(F.count(F.lit(1)).alias("n")), ["_vec"])
    asking = ws.save(spread_join(base.join(asks, "_id").select("_id", "_vec"), classes.select("_vec", "cid"), ["_vec"], shared, ["_id"]).select(F.col("_id").alias("query_id"), "cid"))
    queries = asking.select("cid").distinct().join(classes.select("cid", "_vec"), "cid")
    # Some thousand bands at most, as a double's exponent is bounded, and their longest vectors.
    sizes = classes.groupBy("_band").agg(F.max("_len").alias("longest")).collect()
    hashed = {r["_band"]: r["longest"] for r in sizes}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, band = _matrix(batch.column(1).to_pylist()), batch.column(2).to_numpy()
            for own in np.unique(band).tolist():
                at = np.flatnonzero(band == own)
                yield _placed(batch.column(0), at, _of_band(hashing.buckets(_unit(m[at], hashed[own])), own))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, at = _matrix(batch.column(1).to_pylist()), np.arange(batch.num_rows)
            keys = hashing.visits(np.column_stack((m / np.sqrt((m * m).sum(axis=1, keepdims=True)), np.zeros(len(m)))))
            for own in hashed:
                yield _placed(batch.column(0), at, _of_band(keys, own))

    def nearest(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "cids": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        here = here.sort_values("cid")
        v, ids = _matrix(here["_vec"].tolist()), here["cid"].to_numpy()
        longest = np.sqrt((v * v).sum(axis=1)).max()
        qs = _matrix(there["qv"].tolist())
        out_ids, out_scores = [], []
        for i in range(0, len(qs), 256):
            rough = qs[i : i + 256] @ v.T
            n = min(len(v), keep)
            least = np.partition(rough, len(v) - n, axis=1)[:, len(v) - n]
            # All that can be among the best by their exact sum: ties, and what rounding may have moved.
            slack = 4e-16 * (v.shape[1] + 2) * np.sqrt((qs[i : i + 256] ** 2).sum(axis=1)) * longest
            for q, scores, edge in zip(qs[i : i + 256], rough, least - slack):
                own = np.flatnonzero(scores >= edge)
                exact = (v[own] * q).sum(axis=1)
                best = np.argsort(-exact, kind="stable")[:keep]
                out_ids.append(ids[own[best]].tolist())
                out_scores.append(exact[best].tolist())
        return pd.DataFrame({"q": there["q"].to_numpy(), "cids": out_ids, "scores": out_scores})

    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)

    def met(indexed: DataFrame, visits: DataFrame) -> DataFrame:
        """q, cid, score of the best `keep` of each group of each bucket."""
        # Blocks of each bucket, by its numbers of vectors and of visits.
        held = indexed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        asked = visits.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns"))
        blocks = ws.save(held.join(asked, "bucket"))
        ours = indexed.join(blocks, "bucket").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).select("bucket", "cid", "part", each("turns", "turn")).join(classes.select("cid", "_vec"), "cid")
        theirs = visits.join(blocks, "bucket").withColumn("turn", F.pmod(F.xxhash64("cid"), F.col("turns")).cast("int")).select("bucket", "cid", "turn", each("parts", "part")).join(classes.select("cid", "_vec"), "cid")
        theirs = theirs.select(F.col("bucket").alias("b2"), F.col("part").alias("p2"), F.col("turn").alias("t2"), F.col("cid").alias("q"), F.col("_vec").alias("qv"))
        hits = ours.groupBy("bucket", "part", "turn").cogroup(theirs.groupBy("b2", "p2", "t2")).applyInPandas(nearest, "q long, cids array<long>, scores array<double>")
        # At most TABLES * PROBES * blocks lists of `keep` for each query and band; then classes become their ids.
        return hits.select("q", F.explode(F.arrays_zip("scores", "cids")).alias("hit")).select("q", F.col("hit.scores").alias("score"), F.col("hit.cids").alias("cid")).groupBy("q", "cid").agg(F.max("score").alias("score"))

    indexed = classes.select("cid", "_vec", "_band").mapInArrow(place, "bucket long, cid long")
    visits = queries.select("cid", "_vec").mapInArrow(visit, "bucket long, cid long").distinct()
    pairs = met(indexed, visits)
    pairs = ws.save(pairs.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(F.col("_n") <= keep).drop("_n"))
    # Queries with fewer than `keep` ids, itself among them, of a positive score.
    members = pairs.where("score > 0").join(classes.select("cid", F.size("ids").alias("_n")), "cid").groupBy("q").agg(F.sum("_n").alias("_n"))
    weak = ws.save(queries.select("cid").join(members.where(F.col("_n") >= keep), F.col("cid") == F.col("q"), "left_anti"))
    if not weak.isEmpty():
        every = lambda df: df.select(F.lit(ALL).cast("long").alias("bucket"), "cid")
        pairs = pairs.join(weak.select(F.col("cid").alias("q")), "q", "left_anti").unionByName(met(every(classes), every(weak)))
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(F.col("_n") <= keep)
    members = best.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id"))
    top = members.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= keep)
    lists = ws.save(top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("list")))
    shared = hot_keys(asking.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), ["cid"])
    found = spread_join(asking, lists.withColumnRenamed("q", "cid"), ["cid"], shared, ["query_id"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    out = found.select("query_id", F.posexplode("list").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
