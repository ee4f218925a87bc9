"""Pearson correlation and cosine similarity, from sums that are added up in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.operators.encode import Weights, live, matrix, passes
from actlake.operators.topk import top_k

EPSILON = 1e-6


def weight(acts: DataFrame) -> Column:
    """How many positions a row of activations stands for: its n, or 1."""
    return (F.col("n") if "n" in acts.columns else F.lit(1)).cast("double").alias("n")


def counts(batch: pa.RecordBatch) -> np.ndarray:
    """weight() of an Arrow batch, as a column."""
    return batch.column("n").to_numpy(zero_copy_only=False)[:, None]


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    radicand = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return (n * sxy - sx * sy) / (F.sqrt(F.greatest(radicand, F.lit(0.0))) + EPSILON)


def cosine(sxx: Column, syy: Column, sxy: Column) -> Column:
    return sxy / (F.sqrt(sxx * syy) + EPSILON)


def _finished(sxy: DataFrame, sums: DataFrame, positions: int) -> DataFrame:
    """x_id, y_id, pearson, cossim both ways and the diagonal as 0. sxy: x_id < y_id, sxy; sums: feature_id, s, ss."""
    side = lambda c: sums.select(F.col("feature_id").alias(f"{c}_id"), F.col("s").alias(f"s{c}"), F.col("ss").alias(f"s{c}{c}"))
    found = sxy.join(side("x"), "x_id").join(side("y"), "y_id")
    found = found.select("x_id", "y_id", pearson(F.lit(float(positions)), *map(F.col, ("sx", "sy", "sxx", "syy", "sxy"))).alias("pearson"), cosine(*map(F.col, ("sxx", "syy", "sxy"))).alias("cossim"))
    mirrored = found.unionByName(found.select(F.col("y_id").alias("x_id"), F.col("x_id").alias("y_id"), "pearson", "cossim"))
    diagonal = sums.select(F.col("feature_id").alias("x_id"), F.col("feature_id").alias("y_id"), F.lit(0.0).alias("pearson"), F.lit(0.0).alias("cossim"))
    return mirrored.unionByName(diagonal)


def feature_pairs(feat_acts: DataFrame, batches: DataFrame | None, positions: int) -> DataFrame:
    """x_id, y_id, pearson, cossim of features that are active together somewhere, and the diagonal as 0.

    With batches (feature_id, batch_id), only of features in one batch. Pairs meet at a position, whose active
    features are gathered once and paired inside the row, so the join has no skew; sums are partly added up before
    the shuffle.
    """
    rows = feat_acts if batches is None else feat_acts.join(batches, "feature_id")
    keys = ["prompt_idx", "pos"] + ([] if batches is None else ["batch_id"])
    at = rows.groupBy(*keys).agg(F.collect_list(F.struct("feature_id", "act")).alias("own"))
    pairs = at.select(F.explode("own").alias("x"), "own").select("x", F.explode("own").alias("y")).where("x.feature_id < y.feature_id")
    sxy = pairs.groupBy(F.col("x.feature_id").alias("x_id"), F.col("y.feature_id").alias("y_id")).agg(F.sum(F.col("x.act") * F.col("y.act")).alias("sxy"))
    sums = feat_acts.groupBy("feature_id").agg(F.sum("act").alias("s"), F.sum(F.col("act") * F.col("act")).alias("ss"))
    return _finished(sxy, sums, positions)


def feature_gram(acts: DataFrame, encoder: DataFrame, batches: DataFrame, positions: int) -> DataFrame:
    """The same for features (ReLU) of one batch, from the activations themselves.

    Each task adds up a Gram matrix for each batch of features over its rows, and emits one row a pair; no row leaves a
    worker for each position. batches: feature_id, batch_id. No features give no rows.
    """
    pairs = sums = None
    for rows in passes(encoder.join(batches, "feature_id"), ["batch_id"], whole="batch_id"):
        own, of = Weights(rows), np.array([r["batch_id"] for r in rows])
        groups = [np.flatnonzero(of == g) for g in np.unique(of)]
        shared = acts.sparkSession.sparkContext.broadcast((own, groups))

        def run(batches: Iterator, shared=shared) -> Iterator:
            own, groups = shared.value
            gram, s = [np.zeros((len(g), len(g))) for g in groups], np.zeros(len(own.ids))
            seen = False
            for batch in batches:
                for _, h in own.apply(matrix(batch.column(0), own.w.shape[0])):
                    h = np.maximum(h, 0.0)
                    s += h.sum(axis=0)
                    for total, g in zip(gram, groups):
                        total += h[:, g].T @ h[:, g]
                    seen = True
            for total, g in zip(gram, groups) if seen else ():
                x, y = np.triu_indices(len(g))
                cols = own.ids[g[x]], own.ids[g[y]], total[x, y], np.where(x == y, s[g[x]], 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["x_id", "y_id", "sxy", "s"])

        part = live(acts).select("act").mapInArrow(run, "x_id int, y_id int, sxy double, s double").groupBy("x_id", "y_id").agg(F.sum("sxy").alias("sxy"), F.sum("s").alias("s")).where("sxy > 0")
        pairs = part.where("x_id < y_id") if pairs is None else pairs.unionByName(part.where("x_id < y_id"))
        own = part.where("x_id = y_id").select(F.col("x_id").alias("feature_id"), "s", F.col("sxy").alias("ss"))
        sums = own if sums is None else sums.unionByName(own)
    if pairs is None:
        return acts.sparkSession.createDataFrame([], "x_id int, y_id int, pearson double, cossim double")
    return _finished(pairs.drop("s"), sums, positions)


#: Features of a block; parts of the positions whose norms bound a pair's product.
BLOCK, PARTS = 2_048, 64


def _profiles(acts: DataFrame, encoder: DataFrame) -> DataFrame:
    """feature_id, part, s, ss: sums and squares of each feature over each part of the positions, added up in the tasks."""
    schema, out = "feature_id int, part int, s double, ss double", None
    for rows in passes(encoder, []):
        shared = acts.sparkSession.sparkContext.broadcast(Weights(rows))

        def run(batches: Iterator, shared=shared) -> Iterator:
            own, s, ss, part = shared.value, 0.0, 0.0, None
            for batch in batches:
                part, n = batch.column(1)[0].as_py() if part is None and batch.num_rows else part, counts(batch)
                for i, h in own.apply(matrix(batch.column(0), own.w.shape[0])):
                    h = np.maximum(h, 0.0)
                    s, ss = s + (h * n[i : i + len(h)]).sum(axis=0), ss + (h * h * n[i : i + len(h)]).sum(axis=0)
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(np.full(len(own.ids), part, dtype=np.int32)), pa.array(s), pa.array(ss)], names=["feature_id", "part", "s", "ss"])

        made = live(acts).select("act", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"), weight(acts)).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    out = acts.sparkSession.createDataFrame([], schema) if out is None else out
    return out.groupBy("feature_id", "part").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))


def global_top(acts: DataFrame, encoder: DataFrame, positions: int, k: int, save: Callable[[DataFrame], DataFrame], block: int = BLOCK, decimals: int = 5) -> DataFrame:
    """x_id, rank, y_id, pearson, cossim: each feature's k most correlated others among all features, ties to the smaller id; both values rounded.

    Features are taken in blocks. A pass over the activations multiplies two blocks inside the tasks and gives out one row a
    pair and task, never one a position. Norms over parts of the positions bound each pair's product (Cauchy-Schwarz part by
    part), so two blocks in which no pair can be among the k best so far are left out. Pairs that are never active together
    count as well, as do those of a feature with itself (0), as in feature_gram(). Bounds and thresholds, a few numbers a
    feature, are on the driver. A row of acts stands for n positions, if it has n.
    """
    profiles = save(_profiles(acts, encoder))
    found = profiles.orderBy("feature_id", "part").toLocalIterator()
    ids, s, norms = [], [], []
    for r in found:
        if not ids or ids[-1] != r["feature_id"]:
            ids.append(r["feature_id"])
            s.append(0.0)
            norms.append(np.zeros(PARTS))
        s[-1] += r["s"]
        norms[-1][r["part"]] = r["ss"] ** 0.5
    spark, schema = acts.sparkSession, "x_id int, y_id int, sxy double"
    if not ids:
        return spark.createDataFrame([], "x_id int, rank int, y_id int, pearson double, cossim double")
    ids, s, norms = np.array(ids), np.array(s), np.array(norms)
    ss, n = (norms * norms).sum(axis=1), float(positions)
    spread = np.maximum(n * ss - s * s, 0.0)
    least = np.full(len(ids), -np.inf)  # the k-th best so far

    def bound(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = norms[i] @ norms[j].T
        return (n * most - np.outer(s[i], s[j])) / (np.sqrt(np.outer(spread[i], spread[j])) + EPSILON) + 10.0**-decimals

    def values(pairs: DataFrame) -> DataFrame:
        """Both directions of summed pairs x_id <= y_id, finished."""
        sums = spark.createDataFrame(pd.DataFrame({"id": ids, "s": s, "ss": ss}), "id int, s double, ss double")
        side = lambda c: sums.select(F.col("id").alias(f"{c}_id"), F.col("s").alias(f"s{c}"), F.col("ss").alias(f"s{c}{c}"))
        one = pairs.join(F.broadcast(side("x")), "x_id").join(F.broadcast(side("y")), "y_id")  # a row a feature
        same = F.col("x_id") == F.col("y_id")
        value = lambda c: F.round(F.when(same, 0.0).otherwise(c), decimals)
        one = one.select("x_id", "y_id", value(pearson(F.lit(n), *map(F.col, ("sx", "sy", "sxx", "syy", "sxy")))).alias("pearson"), value(cosine(*map(F.col, ("sxx", "syy", "sxy")))).alias("cossim"))
        return one.unionByName(one.where("x_id <> y_id").select(F.col("y_id").alias("x_id"), F.col("x_id").alias("y_id"), "pearson", "cossim"))

    def products(first: np.ndarray, second: np.ndarray) -> DataFrame:
        own = encoder.where(F.col("feature_id").isin([int(x) for x in {*ids[first], *ids[second]}]))
        rows = own.select("feature_id", "w_enc", "b_enc").orderBy("feature_id").collect()  # two blocks
        place = {r["feature_id"]: c for c, r in enumerate(rows)}
        at = [np.array([place[int(x)] for x in ids[b]]) for b in (first, second)]
        shared = spark.sparkContext.broadcast((Weights(rows), *at))

        def run(batches: Iterator) -> Iterator:
            w, a, b = shared.value
            total = None
            for batch in batches:
                n = counts(batch)
                for i, h in w.apply(matrix(batch.column(0), w.w.shape[0])):
                    h = np.maximum(h, 0.0)
                    part = h[:, a].T @ (h[:, b] * n[i : i + len(h)])
                    total = part if total is None else total + part
            if total is not None:
                x, y = (m.ravel() for m in np.meshgrid(w.ids[a], w.ids[b], indexing="ij"))
                keep = x <= y if a[0] == b[0] else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (np.minimum(x, y), np.maximum(x, y), total.ravel())], names=["x_id", "y_id", "sxy"])

        return live(acts).select("act", weight(acts)).mapInArrow(run, schema).groupBy("x_id", "y_id").agg(F.sum("sxy").alias("sxy"))

    blocks = [np.arange(i, min(i + block, len(ids))) for i in range(0, len(ids), block)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    pairs.sort(key=lambda p: (p[0] != p[1], -float(bound(blocks[p[0]], blocks[p[1]]).max())))
    best = None
    for i, j in pairs:
        if i != j:
            most = bound(blocks[i], blocks[j])
            if (most.max(axis=1) < least[blocks[i]]).all() and (most.max(axis=0) < least[blocks[j]]).all():
                continue
        new = values(products(blocks[i], blocks[j]))
        best = save(top_k((new if best is None else best.unionByName(new)).select("x_id", "y_id", "pearson", "cossim"), ["x_id"], [F.desc("pearson"), F.asc("y_id")], k))
        for r in best.groupBy("x_id").agg(F.min("pearson").alias("p"), F.count(F.lit(1)).alias("n")).collect():  # a row a feature
            if r["n"] == k:
                least[np.searchsorted(ids, r["x_id"])] = r["p"]
        best = best.drop("rank")
    return top_k(best, ["x_id"], [F.desc("pearson"), F.asc("y_id")], k)


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def neuron_sums(acts: DataFrame, encoder: DataFrame) -> DataFrame:
    """feature_id, idx and the sums n, sx, sy, sxx, syy, sxy of features (ReLU) against activation dimensions.

    Each task adds up Gram matrices of its rows and emits one row a feature and dimension; Spark adds those up. The
    activations are read once for each PASS_NUMBERS of the weights. At an outlier no feature is active. A row of acts stands
    for n positions, if it has n.
    """
    masked = F.col("outlier") if "outlier" in acts.columns else F.lit(False)
    schema, out = "feature_id int, idx int, n double, sx double, sy double, sxx double, syy double, sxy double", None
    for rows in passes(encoder, []):
        shared = acts.sparkSession.sparkContext.broadcast(Weights(rows))

        def run(batches: Iterator, shared=shared) -> Iterator:
            own = shared.value
            n, (d, f) = 0, own.w.shape
            sx, sxx, sy, syy, sxy = np.zeros(f), np.zeros(f), np.zeros(d), np.zeros(d), np.zeros((f, d))
            for batch in batches:
                y, on, w = matrix(batch.column(0), d), ~batch.column(1).to_numpy(zero_copy_only=False), counts(batch)
                n += w.sum()
                sy += (y * w).sum(axis=0)
                syy += (y * y * w).sum(axis=0)
                for i, x in own.apply(y):
                    x, some = np.maximum(x, 0.0) * on[i : i + len(x), None], w[i : i + len(x)]
                    sx += (x * some).sum(axis=0)
                    sxx += (x * x * some).sum(axis=0)
                    sxy += x.T @ (y[i : i + len(x)] * some)
            if n:
                cols = [np.repeat(own.ids, d), np.tile(np.arange(d, dtype=np.int32), f), np.full(f * d, float(n)), np.repeat(sx, d), np.tile(sy, f), np.repeat(sxx, d), np.tile(syy, f), sxy.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["feature_id", "idx", *SUMS])

        part = acts.select("act", masked.alias("masked"), weight(acts)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = acts.sparkSession.createDataFrame([], schema) if out is None else out
    return merged(out, ["feature_id", "idx"])


def merged(sums: DataFrame, by: list[str]) -> DataFrame:
    """Sums of several parts of the positions as those of all: partial sums in, whole sums out, in any order."""
    return sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def finalise(sums: DataFrame) -> DataFrame:
    return sums.withColumn("pearson", pearson(*map(F.col, ("n", "sx", "sy", "sxx", "syy", "sxy")))).withColumn("cossim", cosine(*map(F.col, ("sxx", "syy", "sxy"))))
