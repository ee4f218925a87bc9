"""Encoding: activations times weights, and the activation functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.functions.vectors import norm, scale
from actlake.operators.selection import first_rows, nth_rows
from actlake.operators.spread import few
from actlake.operators.stats import bars
from actlake.operators.topk import top_k

#: Decimals that activations are kept with; numbers of a weight matrix that one pass over the activations takes; numbers of a block of results.
DECIMALS, PASS_NUMBERS, BLOCK_NUMBERS = 6, 128_000_000, 4_000_000


class Weights:
    """A model's encoder as arrays, in order of feature_id."""

    def __init__(self, rows: list, least: bool = False):
        self.ids = np.array([r["feature_id"] for r in rows], dtype=np.int32)
        self.w = np.array([r["w_enc"] for r in rows], dtype=np.float64).T
        self.b = np.array([r["b_enc"] for r in rows], dtype=np.float64)
        self.least = np.maximum(np.array([r["threshold"] for r in rows]), 0.0) if least else 0.0

    def apply(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First row and activations [row, feature], by blocks of bounded size."""
        step = max(1, BLOCK_NUMBERS // max(1, len(self.ids)))
        for i in range(0, len(x), step):
            yield i, np.round(x[i : i + step] @ self.w + self.b, DECIMALS) + 0.0


def passes(weights: DataFrame, columns: list[str], whole: str | None = None) -> Iterator[list]:
    """The rows of a weight matrix in order of feature_id, as many at a time as one pass over the activations takes.

    With `whole`, rows come in order of that column, and those that share a value in one pass.
    """
    part, size = [], 0
    order = ["feature_id"] if whole is None else [whole, "feature_id"]
    for r in weights.select("feature_id", "w_enc", "b_enc", *columns).orderBy(*order).toLocalIterator():
        if size >= PASS_NUMBERS and (whole is None or r[whole] != part[-1][whole]):
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r["w_enc"])
    if part:
        yield part


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of arrays as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64, copy=False)


def live(acts: DataFrame) -> DataFrame:
    """Positions that high_norm_mask() has left; all, if there is no mask."""
    return acts.where(~F.col("outlier")) if "outlier" in acts.columns else acts


def encode(acts: DataFrame, weights: DataFrame, keep: str = "positive", key_cols: tuple[str, ...] = ("prompt_idx", "pos", "token_id")) -> DataFrame:
    """feature_id, key columns and act = act . w_enc + b_enc, as blocks of matrix products over Arrow batches.

    keep: "positive" (ReLU, stored without its zeros), "threshold" (JumpReLU: above the weights' threshold, else
    zero) or "all" (probes, which may be negative). Only the rows kept leave the Python worker. The weights are a
    model's parameters and are broadcast; the activations are read once for each PASS_NUMBERS of them.
    """
    names = ["feature_id", *key_cols, "act"]
    types = dict(acts.dtypes) | {"feature_id": "int", "act": "double"}
    schema = ", ".join(f"{c} {types[c]}" for c in names)
    out = None
    for rows in passes(weights, ["threshold"] if keep == "threshold" else []):
        shared = acts.sparkSession.sparkContext.broadcast(Weights(rows, keep == "threshold"))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for i, h in own.apply(matrix(batch.column(len(key_cols)), own.w.shape[0])):
                    row, col = np.nonzero(np.ones_like(h, dtype=bool) if keep == "all" else h > own.least)
                    at = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([pa.array(own.ids[col]), *(batch.column(k).take(at) for k in range(len(key_cols))), pa.array(h[row, col])], names=names)

        part = live(acts).select(*key_cols, "act").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return acts.sparkSession.createDataFrame([], schema) if out is None else out


#: Of activations in a batch: larger ones first, ties to the smaller prompt, position and feature.
BATCH_ORDER = [("act", False), ("prompt_idx", True), ("pos", True), ("feature_id", True)]


def _batched(feat_acts: DataFrame, prompts_per_batch: int) -> DataFrame:
    return feat_acts.withColumn("batch_id", F.floor(F.col("prompt_idx") / prompts_per_batch))


def batch_top_k_edges(feat_acts: DataFrame, k: int, prompts_per_batch: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """batch_id, act, prompt_idx, pos, feature_id: the last activation that each batch keeps; a batch that keeps all has no row.

    A batch of prompts keeps the k * (its positions with an activation) largest over all features, so feat_acts must hold all
    features of the model. The edges can then be applied to any part of them.
    """
    rows = _batched(feat_acts, prompts_per_batch)
    sizes = rows.select("batch_id", "prompt_idx", "pos").distinct().groupBy("batch_id").agg((k * F.count(F.lit(1))).alias("n"))
    return nth_rows(rows, sizes, "batch_id", BATCH_ORDER, save)


def above_edges(feat_acts: DataFrame, edges: DataFrame, prompts_per_batch: int) -> DataFrame:
    """The activations, of some or all features, that batch_top_k_edges() keeps; adds batch_id."""
    return first_rows(_batched(feat_acts, prompts_per_batch), edges, "batch_id", BATCH_ORDER)


def batch_top_k(feat_acts: DataFrame, k: int, prompts_per_batch: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each batch of prompts, the k * (its positions with an activation) largest activations over all features.

    All features are ranked before any is selected. Ties go to the smaller prompt, position and feature.
    """
    return above_edges(feat_acts, batch_top_k_edges(feat_acts, k, prompts_per_batch, save), prompts_per_batch)


def normalise_input(acts: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """(x - mean) / (std + 1e-6); unchanged if any std isn't positive."""
    if any(s <= 0 for s in std):
        return acts
    m, s = (F.array(*map(F.lit, v)) for v in (mean, [x + 1e-6 for x in std]))
    return acts.withColumn("act", F.zip_with(F.zip_with("act", m, lambda x, y: x - y), s, lambda x, y: x / y))


def fold_decoder_norm(encoder: DataFrame, decoder: DataFrame, undo: bool = False) -> DataFrame:
    """Encoder weights and bias times the norm of the feature's decoder row (divided, to undo); a zero norm counts as 1."""
    size = norm(F.col("w_dec"))
    size = F.when(size == 0, 1.0).otherwise(size)
    by = 1 / size if undo else size
    joined = encoder.join(decoder.select("feature_id", "w_dec"), "feature_id")
    return joined.withColumn("w_enc", scale(F.col("w_enc"), by)).withColumn("b_enc", F.col("b_enc") * by).drop("w_dec")


def high_norm_mask(acts: DataFrame, factor: float, prompts_per_batch: int, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Zeroes activations of positions whose norm is above factor times their batch's lower median norm; adds `outlier`.

    No feature is active at such a position: encode() and the correlations leave out what has `outlier`, whatever the bias.
    Norms are taken from a column `norm`, if there is one. With save(), which writes a table and reads it again, medians (a row
    a batch) are found once, and broadcast if they are few.
    """
    size = F.col("norm") if "norm" in acts.columns else norm(F.col("act"))
    rows = acts.withColumn("_norm", F.round(size, DECIMALS)).withColumn("_batch", F.floor(F.col("prompt_idx") / prompts_per_batch))
    medians = rows.groupBy("_batch").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _norm)").alias("_median"))
    rows = rows.join(few(save(medians)) if save else medians, "_batch").withColumn("outlier", F.col("_norm") > factor * F.col("_median"))
    return rows.withColumn("act", F.when(F.col("outlier"), F.transform("act", lambda x: F.lit(0.0))).otherwise(F.col("act"))).drop("_batch")


def masked(feat_acts: DataFrame, ignore_tokens: list[int | None] = (), ignore_positions: list[int] = (), thresholds: DataFrame | None = None) -> DataFrame:
    """Sparse activations without those at ignored tokens or positions, or below their feature's threshold."""
    out = feat_acts
    if tokens := [t for t in ignore_tokens if t is not None]:
        out = out.where(~F.col("token_id").isin(tokens))
    if ignore_positions:
        out = out.where(~F.col("pos").isin(list(ignore_positions)))
    if thresholds is not None:
        out = out.join(thresholds.select("feature_id", F.col("threshold").alias("_least")), "feature_id", "left").where(F.col("act") >= F.coalesce("_least", F.lit(float("-inf")))).drop("_least")
    return out


def logit_lens(decoder: DataFrame, unembed: DataFrame) -> DataFrame:
    """feature_id, token_id, logit = w_dec . w_u, as matrix products over the vocabulary."""
    weights = decoder.select("feature_id", F.col("w_dec").alias("w_enc"), F.lit(0.0).alias("b_enc"))
    out = encode(unembed.select("token_id", F.col("w_u").alias("act")), weights, keep="all", key_cols=("token_id",))
    return out.withColumnRenamed("act", "logit")


def logit_lens_top(decoder: DataFrame, unembed: DataFrame, k: int, smallest: bool = False) -> DataFrame:
    """feature_id, rank, token_id, logit of each feature's k largest (smallest) logits, ties to the smaller token.

    Each task keeps the best k of its part of the vocabulary; only those leave it.
    """
    sign = -1.0 if smallest else 1.0
    weights = decoder.select("feature_id", F.col("w_dec").alias("w_enc"), F.lit(0.0).alias("b_enc"))
    out = None
    for rows in passes(weights, []):
        shared = unembed.sparkSession.sparkContext.broadcast(Weights(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best, ids = np.empty((len(own.ids), 0)), np.empty((len(own.ids), 0), np.int64)
            for batch in batches:
                tokens = batch.column(0).to_numpy(zero_copy_only=False)
                for i, h in own.apply(matrix(batch.column(1), own.w.shape[0])):
                    best = np.concatenate((best, sign * h.T), axis=1)
                    ids = np.concatenate((ids, np.broadcast_to(tokens[i : i + len(h)], (len(own.ids), len(h)))), axis=1)
                    order = np.stack([np.lexsort((t, -v))[:k] for v, t in zip(best, ids)])
                    best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
            if best.size:
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.ids, n)), pa.array(ids.ravel().astype(np.int32)), pa.array(sign * best.ravel() + 0.0)], names=["feature_id", "token_id", "logit"])

        part = unembed.select("token_id", "w_u").mapInArrow(run, "feature_id int, token_id int, logit double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, ["feature_id"], [F.asc("logit") if smallest else F.desc("logit"), F.asc("token_id")], k)


def logit_ranges(decoder: DataFrame, unembed: DataFrame) -> DataFrame:
    """feature_id, lo, hi: the smallest and largest logit of each feature, found in the tasks; a row a task and feature leaves them."""
    weights = decoder.select("feature_id", F.col("w_dec").alias("w_enc"), F.lit(0.0).alias("b_enc"))
    schema, out = "feature_id int, lo double, hi double", None
    for rows in passes(weights, []):
        shared = unembed.sparkSession.sparkContext.broadcast(Weights(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            lo, hi = np.full(len(own.ids), np.inf), np.full(len(own.ids), -np.inf)
            for batch in batches:
                for _, h in own.apply(matrix(batch.column(0), own.w.shape[0])):
                    lo, hi = np.minimum(lo, h.min(axis=0)), np.maximum(hi, h.max(axis=0))
            if np.isfinite(lo).all():
                yield pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(lo), pa.array(hi)], names=["feature_id", "lo", "hi"])

        part = unembed.select("w_u").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = unembed.sparkSession.createDataFrame([], schema) if out is None else out
    return out.groupBy("feature_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def logit_histogram(decoder: DataFrame, unembed: DataFrame, bins: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """feature_id, bin, height, bar_value of each feature's logits, as stats.histogram() gives it.

    Two passes over the vocabulary: edges, then counts. No logit leaves a task: it gives out its count of each bin.
    """
    edges = save(logit_ranges(decoder, unembed))
    weights = decoder.select("feature_id", F.col("w_dec").alias("w_enc"), F.lit(0.0).alias("b_enc")).join(edges, "feature_id")
    schema, out = "feature_id int, bin int, height long", None
    for rows in passes(weights, ["lo", "hi"]):
        ends = np.array([[r["lo"], r["hi"]] for r in rows]).T
        shared = unembed.sparkSession.sparkContext.broadcast((Weights(rows), *ends))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, lo, hi = shared.value
            width, flat = (hi - lo) / bins, hi == lo
            counts, first = np.zeros(len(lo) * bins, dtype=np.int64), np.arange(len(lo)) * bins
            for batch in batches:
                for _, h in own.apply(matrix(batch.column(0), own.w.shape[0])):
                    at = np.minimum(np.floor((h - lo) / np.where(flat, 1.0, width)), bins - 1).astype(np.int64)
                    counts += np.bincount((np.where(flat, bins // 2, at) + first).ravel(), minlength=len(counts))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[some // bins]), pa.array((some % bins).astype(np.int32)), pa.array(counts[some])], names=["feature_id", "bin", "height"])

        part = unembed.select("w_u").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    out = unembed.sparkSession.createDataFrame([], schema) if out is None else out
    return bars(edges, out.groupBy("feature_id", "bin").agg(F.sum("height").alias("height")), "feature_id", bins)


def second_moments(vectors: DataFrame, column: str) -> DataFrame:
    """i, row: the matrix of mean products of a vector's components, over all vectors.

    Each task adds up the products of its rows and emits one row a component; those of all tasks are added by component.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                total, n = x.T @ x if total is None else total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(np.full(len(total), n)), pa.array(list(total))], names=["i", "n", "row"])

    def mean(parts: pa.Table) -> pa.Table:
        rows = np.stack(parts.column("row").combine_chunks().to_numpy(zero_copy_only=False))
        return pa.table({"i": parts.column("i").slice(0, 1), "row": pa.array([rows.sum(axis=0) / parts.column("n").to_numpy().sum()])})

    parts = vectors.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(products, "i long, n long, row array<double>")
    return parts.groupBy("i").applyInArrow(mean, "i long, row array<double>")


def through_output(decoder: DataFrame, w_out: DataFrame) -> DataFrame:
    """Residual directions of features whose decoder writes before an output matrix: w_dec @ w_out. w_out: i, row (array).

    The matrix is turned, and its columns are taken as weights over the decoder's rows.
    """
    places = w_out.select("i", F.posexplode("row").alias("j", "v"))
    columns = places.groupBy(F.col("j").alias("feature_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("w_enc")).withColumn("b_enc", F.lit(0.0))
    out = encode(decoder.select(F.col("feature_id").alias("of"), F.col("w_dec").alias("act")), columns, keep="all", key_cols=("of",))
    ordered = F.array_sort(F.collect_list(F.struct("feature_id", "act")))
    return out.groupBy(F.col("of").alias("feature_id")).agg(F.transform(ordered, lambda x: x["act"]).alias("resid_dir"))


def gather_shards(*shards: DataFrame) -> DataFrame:
    """Weights that were stored in shards of features, without the rows that only fill a shard up."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.where(F.col("w_enc").isNotNull())


def layer_decoder(decoder: DataFrame, layer: int) -> DataFrame:
    """Rows that decode from a layer to itself; none is an error."""
    own = decoder.where((F.col("from_layer") == layer) & (F.col("to_layer") == layer))
    if own.isEmpty():
        raise KeyError(f"no decoder {layer}->{layer}")
    return own
