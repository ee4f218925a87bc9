"""Statistics that are kept up to date as activations arrive.

Counts, sums and maxima of a feature merge, so a streaming aggregate in complete mode holds one row a feature: its
state is bounded by the model, not by the stream. Events with a time use a watermark, so that closed windows leave
the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_stats(stream: DataFrame) -> DataFrame:
    """feature_id, n_active, act_sum, act_max of a stream of sparse activations; for outputMode("complete")."""
    return stream.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_active"), F.sum("act").alias("act_sum"), F.max("act").alias("act_max"))


def windowed_values(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """event_type, start, n, total of each tumbling window; rows later than `late` are dropped with their window's state."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("event_type", F.col("window.start").alias("start"), "n", "total")
