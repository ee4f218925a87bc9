"""Prompt tables: dedupe, sampling, templates, vocabularies and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlake.functions.text import clean_token
from actlake.operators.spread import few
from actlake.operators.topk import draw

SENTINEL = "<|missing token|>"


def texts(token_pos: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """prompt_idx, token_ids in order of position; with `wanted` (prompt_idx, repeats allowed) only of these.

    Positions of other prompts are left out before anything is gathered, so a few windows cost one scan and no shuffle of all.
    """
    if wanted is not None:
        token_pos = token_pos.join(few(wanted.select("prompt_idx").distinct()), "prompt_idx", "left_semi")
    pairs = F.array_sort(F.collect_list(F.struct("pos", "token_id")))
    return token_pos.groupBy("prompt_idx").agg(F.transform(pairs, lambda x: x["token_id"]).alias("token_ids"))


def dedupe(prompts: DataFrame) -> DataFrame:
    """The first prompt of each exact token sequence; grouping by the sequence itself, so hash collisions don't matter."""
    return prompts.groupBy("token_ids").agg(F.min("prompt_idx").alias("prompt_idx")).select("prompt_idx", "token_ids")


def duplicates(prompts: DataFrame) -> DataFrame:
    """token_ids, n of sequences that occur more than once."""
    return prompts.groupBy("token_ids").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def has_duplicates(prompts: DataFrame) -> bool:
    return not duplicates(prompts).isEmpty()


def sample(prompts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n prompts, or all; drawn by the md5 of seed and prompt."""
    return prompts.orderBy(draw(seed, "prompt_idx"), "prompt_idx").limit(n)


def with_affixes(tokens: Column, prefix: list[int], suffix: list[int], keep_first: bool = True) -> Column:
    """Prefix and suffix put around the tokens, which are cut so that the length stays; the first token leads still if keep_first.

    Sequences too short for both raise an error.
    """
    arr = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    lead = 1 if keep_first else 0
    left = F.size(tokens) - lead - len(prefix) - len(suffix)
    out = F.concat(F.slice(tokens, 1, lead), arr(prefix), F.slice(tokens, lead + 1, F.greatest(left, F.lit(0))), arr(suffix))
    return F.when(left < 0, F.raise_error(F.lit("prefix and suffix are longer than the prompt")).cast("array<int>")).otherwise(out)


def with_template(tokens: Column, template: list[int], context: int) -> Column:
    """The first token gives way to the template's tokens; cut to the context size."""
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.slice(F.concat(F.array(*map(F.lit, template)).cast("array<int>"), rest), 1, context)


def clean_vocab(vocab: DataFrame, size: int) -> DataFrame:
    """token_id, token for all ids below size: artefacts replaced, missing ids as SENTINEL; ids beyond are dropped."""
    every = vocab.sparkSession.range(size).select(F.col("id").cast("int").alias("token_id"))
    return every.join(vocab, "token_id", "left").select("token_id", F.coalesce(clean_token(F.col("token")), F.lit(SENTINEL)).alias("token"))


def balanced_batches(features: DataFrame, size: int) -> DataFrame:
    """feature_id, batch_id: ceil(F / size) batches of nearly equal size in order of id; the first ones may have one more."""
    n = max(1, -(-features.count() // size))
    return features.select("feature_id", (F.ntile(n).over(Window.orderBy("feature_id")) - 1).alias("batch_id"))


def fixed_batches(features: DataFrame, size: int) -> DataFrame:
    return features.select("feature_id", F.floor((F.row_number().over(Window.orderBy("feature_id")) - 1) / size).cast("int").alias("batch_id"))


def universe(spark: SparkSession, n: int, only: list[int] | None = None) -> DataFrame:
    every = spark.range(n).select(F.col("id").cast("int").alias("feature_id"))
    return every if only is None else every.where(F.col("feature_id").isin(only))


def skipped(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features that aren't targets."""
    return features.select("feature_id").join(targets.select("feature_id"), "feature_id", "left_anti")


def to_run(batches: DataFrame, done: DataFrame, start: int, end: int) -> DataFrame:
    """Batch ids between start and end, both included, that aren't written yet."""
    return batches.select("batch_id").distinct().where(F.col("batch_id").between(start, end)).join(done.select("batch_id"), "batch_id", "left_anti")


def by_statistic(stats: DataFrame, column: str, low: float, high: float, n: int | None = None, seed: int = 0) -> DataFrame:
    """Features whose statistic lies in a range, all or n drawn ones."""
    found = stats.where(F.col(column).between(low, high)).select("feature_id")
    return found if n is None else found.orderBy(draw(seed, "feature_id")).limit(n)
