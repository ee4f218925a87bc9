"""Top-k and seeded sampling per group. row_number keeps exactly k; Spark limits each partition before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group in the given order, with their rank from 1. Groups of fewer rows are returned whole."""
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank_col) <= k)


def top_positions(feat_acts: DataFrame, k: int, smallest: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """The k positions of each feature with the largest (smallest) activations; ties to the smaller prompt, then position.

    counted: feature_id, act, n, how often each value occurs. With it, only rows from the k-th largest value up are sorted.
    """
    if counted is not None and not smallest:
        values = counted.groupBy("feature_id", "act").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("feature_id").orderBy(F.desc("act")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        least = values.withColumn("_above", above).where(F.col("_above") < k).groupBy("feature_id").agg(F.min("act").alias("_least"))
        feat_acts = feat_acts.join(F.broadcast(least), "feature_id").where(F.col("act") >= F.col("_least")).drop("_least")  # a row a feature
    order = [F.asc("act") if smallest else F.desc("act"), F.asc("prompt_idx"), F.asc("pos")]
    return top_k(feat_acts, ["feature_id"], order, k)


def inside_buffer(df: DataFrame, lengths: DataFrame, before: int, after: int) -> DataFrame:
    """Positions with at least before + 1 tokens to the left and `after` to the right in their prompt. lengths: prompt_idx, n_tokens."""
    return df.join(lengths, "prompt_idx").where((F.col("pos") >= before + 1) & (F.col("pos") < F.col("n_tokens") - after)).drop("n_tokens")


def draw(seed: int, *parts: str) -> Column:
    """A sampling key that depends on the row alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)))


def sample_k(df: DataFrame, by: list[str], parts: list[str], k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, uniform without replacement and the same in every run; all rows of smaller groups."""
    return top_k(df, by, [draw(seed, *parts).asc()], k)


def masked_top_k(df: DataFrame, by: list[str], mask: Column, order: list[Column], k: int, value: str, index: str) -> DataFrame:
    """rank, value and index of the first k rows of each group that the mask admits; a group with fewer admitted rows is filled up with 0 and 0.

    k is at most the number of a group's rows.
    """
    groups = df.groupBy(*by).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_k"))
    every = groups.select(*by, F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))).alias("rank"))
    best = top_k(df.where(mask).select(*by, value, index), by, order, k)
    filled = every.join(best, [*by, "rank"], "left")
    return filled.select(*by, "rank", *(F.coalesce(c, F.lit(0)).cast(df.schema[c].dataType).alias(c) for c in (value, index)))
