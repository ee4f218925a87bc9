"""Sequence groups of a feature's report: top activations, intervals, and the token windows around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlake.operators.encode import logit_lens
from actlake.operators.prompts import texts
from actlake.operators.spread import few
from actlake.operators.topk import draw, top_k, top_positions


def groups(feat_acts: DataFrame, positions: int, intervals: int, counted: DataFrame | None = None) -> DataFrame:
    """feature_id, group_ord, kind, lower, upper, pct: the top group is 0, intervals follow from the highest to the lowest.

    Intervals have equal width between 0 and the feature's maximum, closed on both sides; pct is their share of all
    positions, zeros included. counted: feature_id, act, n, how often each value occurs; taken from feat_acts if left out.
    """
    counted = feat_acts.select("feature_id", "act", F.lit(1).cast("long").alias("n")) if counted is None else counted
    best = counted.groupBy("feature_id").agg(F.max("act").alias("m"))
    i = F.col("i")
    bounds = best.select("feature_id", "m", F.explode(F.sequence(F.lit(0), F.lit(intervals - 1))).alias("i")) if intervals else best.limit(0).withColumn("i", F.lit(0))
    bounds = bounds.select("feature_id", (intervals - i).cast("int").alias("group_ord"), F.lit("INTERVAL").alias("kind"), F.round(F.col("m") * i / max(1, intervals), 6).alias("lower"), F.round(F.col("m") * (i + 1) / max(1, intervals), 6).alias("upper"))
    counts = held(counted, bounds)
    active = counted.groupBy("feature_id").agg(F.sum("n").alias("active"))
    shares = bounds.join(counts, ["feature_id", "group_ord"], "left").join(active, "feature_id")
    zeros = F.when(F.col("lower") <= 0, F.lit(positions) - F.col("active")).otherwise(0)
    shares = shares.select("feature_id", "group_ord", "kind", "lower", "upper", ((F.coalesce("n", F.lit(0)) + zeros) / positions).alias("pct"))
    top = best.select("feature_id", F.lit(0).alias("group_ord"), F.lit("TOP").alias("kind"), F.lit(0.0).alias("lower"), F.col("m").alias("upper"), F.lit(1.0).alias("pct"))
    return top.unionByName(shares)


def held(counted: DataFrame, intervals: DataFrame) -> DataFrame:
    """feature_id, group_ord, n: activations in each interval. Intervals are a few rows a feature and are broadcast."""
    inside = counted.join(F.broadcast(intervals.select("feature_id", "group_ord", "lower", "upper")), "feature_id").where(F.col("act").between(F.col("lower"), F.col("upper")))
    return inside.groupBy("feature_id", "group_ord").agg(F.sum("n").alias("n"))


#: Positions that are drawn from at first for each that is wanted; of a sample's candidates, so many are held by the driver.
SPARE, HELD = 64, 100_000


def inactive_sample(feat_acts: DataFrame, features: DataFrame, token_pos: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """feature_id, prompt_idx, pos, _key: each feature's first k inactive positions in the order of a hash of the position.

    All features see positions in one order, so the first few serve them all. Where a feature is active at too many
    of these, more are taken, until every feature has k or positions run out.
    """
    ordered = token_pos.select("prompt_idx", "pos").withColumn("_key", draw(seed, "prompt_idx", "pos"))
    n, ids = max(k, round(SPARE * k)), _ids(features)
    while True:
        first = ordered.orderBy("_key", "prompt_idx", "pos").limit(n)
        if n <= HELD:  # so positions are sorted once
            first = token_pos.sparkSession.createDataFrame(first.toArrow(), first.schema)
        found = first.withColumn("feature_id", F.explode(F.array(*map(F.lit, ids))))
        near = feat_acts.select("feature_id", "prompt_idx", "pos").join(few(first.select("prompt_idx", "pos")), ["prompt_idx", "pos"], "left_semi")
        zeros = found.join(near, ["feature_id", "prompt_idx", "pos"], "left_anti")
        kept = top_k(zeros, ["feature_id"], [F.asc("_key"), F.asc("prompt_idx"), F.asc("pos")], k).drop("rank")
        short = kept.groupBy("feature_id").count().where(F.col("count") >= k).count() < len(ids)
        if not short or first.count() < n:
            return kept
        n *= 16


def _ids(features: DataFrame) -> list[int]:
    """Feature ids of one report; a model's parameter."""
    return sorted(r["feature_id"] for r in features.select("feature_id").distinct().collect())


def members(feat_acts: DataFrame, token_pos: DataFrame, grouped: DataFrame, top: int, per_interval: int, seed: int = 0, counted: DataFrame | None = None, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """feature_id, group_ord, rank, prompt_idx, pos, act of the rows of each group.

    Intervals are sampled in the order of a hash of the position. The lowest interval holds the zeros as well. With counted
    (feature_id, act, n) and save(), which writes a table and reads it again, only rows with a small hash are sorted: SPARE times
    as many as are wanted, as an interval's size lets expect. An interval that comes out short is taken whole.
    """
    best = top_positions(feat_acts, top, counted=counted).select("feature_id", F.lit(0).alias("group_ord"), "rank", "prompt_idx", "pos", "act")
    intervals = grouped.where("kind = 'INTERVAL'").select("feature_id", "group_ord", "lower", "upper")
    def keyed(intervals: DataFrame) -> DataFrame:
        rows = feat_acts.join(F.broadcast(intervals), "feature_id").where(F.col("act").between(F.col("lower"), F.col("upper")))  # a few rows a feature
        return rows.withColumn("_key", draw(seed, "prompt_idx", "pos"))

    columns = ["feature_id", "group_ord", "prompt_idx", "pos", "act", "_key"]
    if counted is None or save is None:
        some = keyed(intervals).select(columns)
    else:
        sizes = save(intervals.join(held(counted, intervals), ["feature_id", "group_ord"]))
        share = sizes.withColumn("_below", F.ceil(F.lit(2.0**32 * SPARE * per_interval) / F.col("n")))
        some = save(keyed(share).where(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") < F.col("_below")).select(columns))
        found = some.groupBy("feature_id", "group_ord").agg(F.count(F.lit(1)).alias("found"))
        short = save(sizes.join(found, ["feature_id", "group_ord"], "left").where(F.coalesce("found", F.lit(0)) < F.least(F.col("n"), F.lit(per_interval))))
        if not short.isEmpty():
            some = some.join(F.broadcast(short), ["feature_id", "group_ord"], "left_anti").unionByName(keyed(short).select(columns))
    lowest = intervals.where("lower <= 0").select("feature_id", "group_ord")
    zeros = inactive_sample(feat_acts, lowest, token_pos, per_interval, seed).join(lowest, "feature_id").select("feature_id", "group_ord", "prompt_idx", "pos", F.lit(0.0).alias("act"), "_key")
    order = [F.asc("_key"), F.asc("prompt_idx"), F.asc("pos")]
    drawn = top_k(some.unionByName(zeros), ["feature_id", "group_ord"], order, per_interval)
    return best.unionByName(drawn.select("feature_id", "group_ord", "rank", "prompt_idx", "pos", "act"))


def windows(rows: DataFrame, token_pos: DataFrame, before: int | None, after: int) -> DataFrame:
    """Adds start and window (token ids around the row's position; cut at the prompt's ends). before None: the whole prompt without its first token.

    Only the rows' own prompts are put together from token_pos (prompt_idx, pos, token_id).
    """
    joined = rows.join(texts(token_pos, rows), "prompt_idx")
    if before is None:
        return joined.withColumn("start", F.lit(1)).withColumn("window", F.expr("slice(token_ids, 2, greatest(size(token_ids) - 1, 0))")).drop("token_ids")
    start = F.greatest(F.col("pos") - before, F.lit(0))
    return joined.withColumn("start", start).withColumn("window", F.slice("token_ids", F.col("start") + 1, F.col("pos") + after + 1 - F.col("start"))).drop("token_ids")


def window_acts(rows: DataFrame, feat_acts: DataFrame, whole: bool = True) -> DataFrame:
    """Adds acts: the row's feature over its window, zeros included, 4 decimals; without `whole` only the row's own position counts.

    rows: feature_id, group_ord, rank, prompt_idx, pos, act, start, window. The prompts of the rows are few, so their
    activations are found by a join on feature and prompt.
    """
    if not whole:
        own = F.transform("window", lambda t, i: F.when(i + F.col("start") == F.col("pos"), F.round("act", 4)).otherwise(0.0))
        return rows.withColumn("acts", own)
    keys = rows.select("feature_id", "prompt_idx").distinct()
    maps = feat_acts.join(few(keys), ["feature_id", "prompt_idx"]).groupBy("feature_id", "prompt_idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "act"))).alias("_by_pos"))
    joined = rows.join(maps, ["feature_id", "prompt_idx"], "left")
    acts = F.transform("window", lambda t, i: F.round(F.coalesce(F.try_element_at("_by_pos", (i + F.col("start")).cast("int")), F.lit(0.0)), 4))
    return joined.withColumn("acts", acts).drop("_by_pos")


def with_token_logits(rows: DataFrame, decoder: DataFrame, unembed: DataFrame) -> DataFrame:
    """Adds token_logits: the feature's logit of each token of its windows. Only tokens that occur in a window are unembedded."""
    keys = ["feature_id", "group_ord", "rank"]
    places = rows.select(*keys, F.posexplode("window").alias("i", "token_id"))
    own = unembed.join(few(places.select("token_id").distinct()), "token_id", "left_semi")
    found = places.join(logit_lens(decoder, own), ["feature_id", "token_id"], "left")
    lists = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "logit"))), lambda x: x["logit"]).alias("token_logits"))
    return rows.join(lists, keys, "left")


def packaged(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row a feature: its groups in order, each with bounds and its sequences in order of rank; a group without any has none.

    rows: as with_token_logits() returns them.
    """
    seq = F.struct("rank", F.col("prompt_idx").alias("original_index"), F.col("pos").alias("qualifying_token_index"), "start", F.col("window").alias("token_ids"), F.col("acts").alias("feat_acts"), "token_logits")
    per_group = rows.groupBy("feature_id", "group_ord").agg(F.array_sort(F.collect_list(seq)).alias("sequences"))
    full = grouped.join(per_group, ["feature_id", "group_ord"], "left").withColumn("sequences", F.coalesce("sequences", F.expr("array()")))
    return full.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("group_ord", "kind", "lower", "upper", "pct", "sequences"))).alias("groups"))


def neighbours(feat_acts: DataFrame, token_pos: DataFrame) -> DataFrame:
    """Each position's tokens before and after it, and the feature's activation at the position before (0 where inactive)."""
    order = Window.partitionBy("prompt_idx").orderBy("pos")
    around = token_pos.select("prompt_idx", "pos", F.lead("token_id").over(order).alias("next_token"), F.lag("token_id").over(order).alias("prev_token"))
    prev = feat_acts.select("feature_id", "prompt_idx", (F.col("pos") + 1).alias("pos"), F.col("act").alias("prev_act"))
    return feat_acts.join(around, ["prompt_idx", "pos"]).join(prev, ["feature_id", "prompt_idx", "pos"], "left").withColumn("prev_act", F.coalesce("prev_act", F.lit(0.0)))


def argmax_positions(feat_acts: DataFrame) -> DataFrame:
    """feature_id, prompt_idx, pos, act of a feature's largest activation in each prompt, the first on ties."""
    best = feat_acts.groupBy("feature_id", "prompt_idx").agg(F.max(F.struct("act", (-F.col("pos")).alias("neg"))).alias("b"))
    return best.select("feature_id", "prompt_idx", (-F.col("b.neg")).alias("pos"), F.col("b.act").alias("act"))


def offsets(grouped: DataFrame, sizes: DataFrame) -> DataFrame:
    """Running start of each group's rows among a feature's rows."""
    order = Window.partitionBy("feature_id").orderBy("group_ord").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.select("feature_id", "group_ord").join(sizes, ["feature_id", "group_ord"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("first_row", F.coalesce(F.sum("n").over(order), F.lit(0)))
