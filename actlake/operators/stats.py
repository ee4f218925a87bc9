"""Statistics of features over all token positions. Activations are sparse: positions without a row are zero."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlake.functions.vectors import total

#: Numbers of a quantile table that are broadcast at once.
TABLE_NUMBERS = 8_000_000

#: Ranges of the quantile grid, and decimals of the labels in each.
RANGES = (([0.0, 0.95], 3), ([0.95, 0.99], 4), ([0.99, 1.0], 5))


def quantile_grid() -> list[float]:
    """Steps of 1e-3, 1e-4 and 1e-5 towards 1, then 1 itself."""
    return [round(lo + i * 10.0**-d, d) for (lo, hi), d in RANGES for i in range(round((hi - lo) * 10**d))] + [1.0]


def density(feat_acts: DataFrame, features: DataFrame, positions: int) -> DataFrame:
    """feature_id, max_act, n_active, frac_active (act > 0) and frac_nonzero (|act| > 1e-6) of every feature."""
    agg = feat_acts.groupBy("feature_id").agg(F.max("act").alias("m"), F.count_if(F.col("act") > 0).alias("n"), F.count_if(F.abs("act") > 1e-6).alias("z"), F.count(F.lit(1)).alias("rows"))
    out = features.select("feature_id").join(agg, "feature_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "feature_id",
        F.when(F.coalesce("rows", F.lit(0)) < positions, F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("m")).alias("max_act"),
        n.alias("n_active"),
        F.round(n / positions, 6).alias("frac_active"),
        F.round(F.coalesce("z", F.lit(0)) / positions, 6).alias("frac_nonzero"),
    )


def moments(feat_acts: DataFrame, positions: int) -> DataFrame:
    """feature_id, mean, skewness and excess kurtosis over all positions (population forms), from sums of powers. A row stands for n positions, if it has n."""
    held = F.col("n") if "n" in feat_acts.columns else F.lit(1)
    s = feat_acts.groupBy("feature_id").agg(*(F.sum(F.pow("act", F.lit(p)) * held).alias(f"s{p}") for p in (1, 2, 3, 4)))
    n = F.lit(float(positions))
    m = F.col("s1") / n
    m2 = F.col("s2") / n - m**2
    m3 = F.col("s3") / n - 3 * m * F.col("s2") / n + 2 * m**3
    m4 = F.col("s4") / n - 4 * m * F.col("s3") / n + 6 * m**2 * F.col("s2") / n - 3 * m**4
    safe = F.nullif(F.greatest(m2, F.lit(0.0)), F.lit(0.0))
    return s.select("feature_id", F.round(m, 6).alias("mean_act"), F.round(m3 / F.pow(safe, 1.5), 4).alias("skewness"), F.round(m4 / (safe * safe) - 3, 4).alias("kurtosis"))


def value_counts(feat_acts: DataFrame) -> DataFrame:
    """feature_id, act, n: each distinct activation value and how often it occurs; partial counts come before the shuffle. A row stands for n positions, if it has n."""
    held = F.col("n") if "n" in feat_acts.columns else F.lit(1).cast("long")
    return feat_acts.where("act > 0").groupBy("feature_id", "act").agg(F.sum(held).alias("n"))


def quantiles(feat_acts: DataFrame, features: DataFrame, positions: int, grid: list[float], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """feature_id, quantile_data: linear-interpolated quantiles at the grid, over all positions with their implicit zeros, 6 decimals.

    Distinct values are counted and sorted in ranges. The running counts of a feature's ranges say in which range each
    wanted rank lies; inside a range it is looked up among the running counts of its values. So a feature of any number
    of activations is spread over many tasks. save() writes a table and reads it again.
    """
    ranged = save(save(value_counts(feat_acts)).repartitionByRange("feature_id", "act").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("feature_id").orderBy("range")
    held = ranged.groupBy("feature_id", "range").agg(F.sum("n").alias("held")).withColumn("end", F.sum("held").over(before)).withColumn("start", F.col("end") - F.col("held"))
    totals = held.groupBy("feature_id").agg(F.max("end").alias("total"))
    rank = F.col("q") * F.lit(float(positions - 1))
    wanted = features.select("feature_id").distinct().join(totals, "feature_id", "left").select("feature_id", (F.lit(positions) - F.coalesce("total", F.lit(0))).alias("zeros"), F.posexplode(F.array(*map(F.lit, grid))).alias("j", "q"))
    low = F.floor(rank)
    sides = F.array(F.struct(F.lit(0).alias("side"), low.alias("at")), F.struct(F.lit(1).alias("side"), F.least(low + 1, F.lit(positions - 1)).alias("at")))
    wanted = wanted.select("feature_id", "j", (rank - low).alias("part"), "zeros", F.explode(sides).alias("x")).select("feature_id", "j", "part", "x.side", (F.col("x.at") - F.col("zeros")).alias("at"))
    asked = wanted.where("at >= 0").join(held.select("feature_id", F.col("range").alias("asked_range"), "start", "end"), "feature_id").where("start <= at AND at < end").select("feature_id", "asked_range", "j", "side", (F.col("at") - F.col("start")).alias("at"))

    def looked_up(values: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("act")
        place = np.searchsorted(values["n"].cumsum().to_numpy(), ranks["at"].to_numpy(), side="right")
        return pd.DataFrame({"feature_id": ranks["feature_id"].to_numpy(), "j": ranks["j"].to_numpy(), "side": ranks["side"].to_numpy(), "act": values["act"].to_numpy()[place]})

    found = ranged.groupBy("feature_id", "range").cogroup(asked.groupBy("feature_id", "asked_range")).applyInPandas(looked_up, "feature_id int, j int, side int, act double")
    both = wanted.join(found, ["feature_id", "j", "side"], "left").groupBy("feature_id", "j").agg(
        F.max("part").alias("part"), *(F.coalesce(F.max(F.when(F.col("side") == i, F.col("act"))), F.lit(0.0)).alias(name) for i, name in ((0, "lo"), (1, "hi")))
    )
    point = F.round(F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo")), 6)
    return both.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", point.alias("v")))), lambda x: x["v"]).alias("quantile_data"))


def without_leading_zeros(values: Column) -> Column:
    """Storage form of a quantile row; functions.vectors.pad() brings the zeros back."""
    return F.slice(values, F.size(F.filter(values, lambda v: v <= 0)) + 1, F.size(values))


def reverse_quantile(value: Column, quantile_data: Column, grid: list[float]) -> tuple[Column, Column]:
    """Label of the first grid point whose quantile isn't below value, and the decimals of labels there."""
    at = F.size(F.filter(quantile_data, lambda q: q < value))
    label = F.element_at(F.array(*map(F.lit, [*grid, 1.0])), at + 1)
    return label, F.when(label >= 0.99, 5).when(label >= 0.95, 4).otherwise(3)


def quantile_labels(values: DataFrame, table: DataFrame, grid: list[float]) -> DataFrame:
    """Adds label (of the first grid point whose quantile isn't below the row's act; 1 beyond) and decimals (of labels there).

    values: feature_id, act and others; features that the table lacks drop out. A feature's quantiles are searched by
    halves in Arrow batches; tables of many features are broadcast in blocks of bounded size.
    """
    schema = T.StructType([*values.schema.fields, T.StructField("label", T.DoubleType()), T.StructField("decimals", T.IntegerType())])
    places = values.columns.index("feature_id"), values.columns.index("act")
    out, part = None, []

    def labelled(part: list) -> DataFrame:
        ids, rows = np.array([r["feature_id"] for r in part]), np.array([r["quantile_data"] for r in part])
        shared = values.sparkSession.sparkContext.broadcast((ids, rows, np.array([*grid, 1.0])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows, grid = shared.value
            for batch in batches:
                own, act = (batch.column(k).to_numpy(zero_copy_only=False) for k in places)
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                known = np.flatnonzero(ids[at] == own)
                label = np.empty(len(known))
                for k in np.unique(at[known]):
                    mine = np.flatnonzero(at[known] == k)
                    label[mine] = grid[np.searchsorted(rows[k], act[known][mine], side="left")]
                decimals = np.where(label >= 0.99, 5, np.where(label >= 0.95, 4, 3)).astype(np.int32)
                columns = batch.take(pa.array(known)).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(label), pa.array(decimals)], names=schema.names)

        return values.where(F.col("feature_id").between(int(ids.min()), int(ids.max()))).mapInArrow(run, schema)

    for r in table.select("feature_id", "quantile_data").orderBy("feature_id").toLocalIterator():
        part.append(r)
        if len(part) * len(grid) >= TABLE_NUMBERS:
            out, part = labelled(part) if out is None else out.unionByName(labelled(part)), []
    if part:
        out = labelled(part) if out is None else out.unionByName(labelled(part))
    return values.sparkSession.createDataFrame([], schema) if out is None else out


def histogram(values: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """key, bin, height, bar_value: equal bins between a key's smallest and largest value, the last closed on both sides.

    All bins are listed; bar_value is the bin's centre to 5 decimals, halves up (hence the 1e-9). Where all values are equal there is one bar, in the middle bin. A key without rows has none.
    """
    edges = values.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), bins // 2).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    heights = values.join(edges, key).groupBy(key, place.alias("bin")).agg(F.count(F.lit(1)).alias("height"))
    return bars(edges, heights, key, bins)


def bars(edges: DataFrame, heights: DataFrame, key: str, bins: int) -> DataFrame:
    """All bins of each key in edges (key, lo, hi), with the heights (key, bin, height) that there are."""
    width = (F.col("hi") - F.col("lo")) / bins
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(heights, [key, "bin"], "left").select(key, "bin", F.coalesce("height", F.lit(0)).cast("long").alias("height"), F.round(F.col("lo") + (F.col("bin") + 0.5) * width + 1e-9, 5).alias("bar_value"))


def ticks(lo: Column, hi: Column) -> Column:
    """Zero and up to 3 ticks a side, multiples of 0.1 chosen so that the longer side has 3; at most 3 on the other, also for tiny ranges."""
    longer = F.greatest(hi, -lo)
    step = 0.1 * F.floor(1e-4 + longer / 0.3) + 1e-6
    shorter = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.least(hi, -lo) / step))).cast("int")
    below, above = F.when(hi > -lo, shorter).otherwise(3), F.when(hi > -lo, 3).otherwise(shorter)
    return F.transform(F.sequence(-below, above), lambda i: F.round(i * step, 1) + 0.0)


def int_ticks(hi: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.floor(hi), F.lit(0)).cast("int"))


def union_stats(*batches: DataFrame) -> DataFrame:
    """Statistics of several feature batches; a feature that occurs again replaces the earlier one."""
    tagged = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    out = tagged[0]
    for b in tagged[1:]:
        out = out.unionByName(b)
    columns = [c for c in out.columns if c not in ("feature_id", "_batch")]
    last = out.groupBy("feature_id").agg(F.max_by(F.struct(*columns), "_batch").alias("_s"))
    return last.select("feature_id", *(F.col(f"_s.{c}") for c in columns))


__all__ = ["density", "histogram", "int_ticks", "moments", "quantile_grid", "quantile_labels", "quantiles", "reverse_quantile", "ticks", "total", "union_stats", "value_counts", "without_leading_zeros"]
