"""Joins and numberings that no key of many rows holds up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than a HOT-th of all rows is hot (so fewer than HOT are), if it has more than HOT_ROWS.
HOT, HOT_ROWS = 1_000, 500


def hot_keys(counts: DataFrame, on: list[str], n_col: str = "n") -> DataFrame | None:
    """on and _parts (pieces to deal a key's rows to) of hot keys, fewer than HOT rows; None if there is none.

    counts: each key once, with its number of rows.
    """
    total = counts.agg(F.sum(n_col)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT)
    rows = counts.where(F.col(n_col) > limit).select(*on, F.ceil(F.col(n_col) / limit).cast("int").alias("_parts")).toArrow()
    return counts.sparkSession.createDataFrame(rows) if rows.num_rows else None  # from Arrow, no Python worker makes its rows


#: Rows of a table that is broadcast.
FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most FEW rows; it is counted for that."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def spread_join(many: DataFrame, one: DataFrame, on: list[str], hot: DataFrame | None, spread_by: list[str], how: str = "inner") -> DataFrame:
    """many.join(one, on, how), where the rows of a hot key are dealt to several tasks by spread_by.

    `one` has few rows a key (mostly one): those of hot keys are repeated for each piece. how: inner, left, left_semi
    or left_anti. Null keys meet nothing.
    """
    if hot is None:
        return many.join(one, on, how)
    hot = F.broadcast(hot)  # fewer than HOT rows
    left = many.join(hot, on, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = one.join(hot, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_piece"], how).drop("_piece")


def numbered(df: DataFrame, order: list[str], name: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds name: the row's number from 0 in ascending order.

    Ranges of the order are numbered apart and shifted by the sizes of the ranges before; save() writes a table and
    reads it again, so that the ranges stay as they are.
    """
    df = save(df)  # ranges are sampled, so it is read twice
    ranged = save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    starts, start = [], 0
    for r, n in sizes:
        starts.append((r, start))
        start += n
    shift = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _start long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(shift, "_range").withColumn(name, F.col("_start") + own).drop("_range", "_start")
