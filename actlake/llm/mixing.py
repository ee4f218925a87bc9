"""Mixing sources to target weights by cube-method balanced sampling.

A source's target, divided by its size, is the number of times each of its documents is wanted: a whole number of
copies for all, and one more copy with the fractional probability that is left. The cube method decides who gets the
extra copy so that both the documents and the tokens drawn meet their expected totals. Flight phase: a block of
documents of one source moves its vector of probabilities along a null-space direction of the two balancing
constraints until one of them reaches 0 or 1, again and again; at most two stay undecided. The undecided of all
blocks meet in new blocks of the next round, and so on until one block a source is left, which the smallest documents
of the source join. There landing settles the last two and turns over a few settled ones, so that the total is met as
nearly as can be. Blocks have a bounded size, so a source of any size is spread out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlake.llm.common import Workspace, bounded_batches, partitions

WEIGHTS, SHARE, MAX_COPIES, BLOCK, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 2_000, 17
#: Documents of which landing tries all subsets, and the words of the longest of them.
LAND_DOCS, LAND_WORDS = 40, 200_000
_EPS = 1e-9


@F.pandas_udf(T.LongType())
def word_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Number of [^\\x20\\x09-\\x0D]+ in UTF-8 bytes: what bytes.split() parts. Null: 0."""
    for texts in batches:
        yield pd.Series([len(t.split()) if t else 0 for t in texts], dtype="int64")


word_count = word_count.asNondeterministic()  # else a filter on its result gets a second worker, which counts again


def flight(pi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pi with all but at most two entries at 0 or 1; sum(pi) and sum(pi * sizes) stay as they are.

    Fast flight: three undecided documents at a time give a 2 x 3 system with a null-space direction; the one that
    settles is replaced by the next. The direction's sign and length are drawn so that each pi is kept on average;
    the generator is seeded by the block's content, so that reruns agree.
    """
    pi = pi.copy()
    rng = np.random.default_rng([SEED, len(pi), int(sizes.sum()) & 0x7FFFFFFF])
    draws = rng.random(len(pi) + 1)
    waiting = [int(i) for i in np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))]
    held, k = waiting[:3], 3
    while len(held) == 3:
        p, s = [float(pi[i]) for i in held], [float(sizes[i]) for i in held]
        # u is orthogonal to (1, 1, 1) and to the sizes: their cross product, or any direction if the sizes are equal.
        u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
        if u[0] == u[1] == u[2] == 0.0:
            u = [1.0, -1.0, 0.0]
        up = min((1 - x) / d if d > 0 else x / -d for x, d in zip(p, u) if d)
        down = min(x / d if d > 0 else (1 - x) / -d for x, d in zip(p, u) if d)
        step = up if draws[k - 3] * (up + down) < down else -down
        rest = []
        for i, x, d in zip(held, p, u):
            x = min(1.0, max(0.0, x + step * d))
            pi[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            if 0.0 < pi[i] < 1.0:
                rest.append(i)
        missing = 3 - len(rest)
        held = rest + waiting[k : k + missing]
        k += missing
    return pi


def nearest_turns(turns: list[int], off: int) -> list[int]:
    """Places of the turns whose sum is as near to `off` as any subset's; of several, those with the earlier turns.

    The reachable sums are bits of one number a turn, so the best is found exactly and traced back.
    """
    low = sum(t for t in turns if t < 0)
    reach = [1 << -low]  # bit s - low: the sum s
    for t in turns:
        reach.append(reach[-1] | (reach[-1] << t if t > 0 else reach[-1] >> -t))
    last, at = reach[-1], off - low
    below = (last & ((1 << (at + 1)) - 1)).bit_length() - 1 if at >= 0 else -1
    above = last >> max(at, 0)
    above = max(at, 0) + (above & -above).bit_length() - 1 if above else -1
    best = min((s for s in (below, above) if s >= 0), key=lambda s: abs(s - at))
    out = []
    for k in range(len(turns), 0, -1):
        if not reach[k - 1] >> best & 1:
            out.append(k - 1)
            best -= turns[k - 1]
    return out


def land(pi: np.ndarray, sizes: np.ndarray, wanted: float) -> np.ndarray:
    """Settles the one or two that flight left so that the total of sizes is as near to wanted as can be.

    They are rounded. Then single settled documents are turned over as long as that brings the total nearer, largest step
    first, and last a subset of LAND_DOCS of the smallest documents, the best of all subsets. So the total of a block
    of that many documents is the nearest there is, whatever their sizes.
    """
    out = np.round(pi)
    small = np.flatnonzero((sizes > 0) & (sizes <= LAND_WORDS))
    small = small[np.argsort(sizes[small], kind="stable")][:LAND_DOCS]
    if len(small) < (sizes > 0).sum():  # else all subsets are tried anyway
        for _ in range(LAND_DOCS):
            off = wanted - (out * sizes).sum()
            gap = np.abs(off - np.where(out > 0.5, -sizes, sizes))
            i = int(gap.argmin())
            if gap[i] >= abs(off):
                break
            out[i] = 1.0 - out[i]
    if len(small):
        off = wanted - (out * sizes).sum()
        turned = small[nearest_turns(np.where(out[small] > 0.5, -sizes[small], sizes[small]).astype(int).tolist(), int(round(off)))]
        out[turned] = 1.0 - out[turned]
    return out


def source_targets(ws: Workspace, sizes: DataFrame) -> DataFrame:
    """_source, _rank-based weight, source_size and target of each source. sizes: _source, size.

    Filling: all sources share by weight; one above MAX_COPIES times its size is held there and the rest is shared
    anew, until none is above. Each round is one aggregate over the table of sources.
    """
    totals = ws.save(sizes.groupBy("_source").agg(F.sum("size").alias("source_size")))
    # Ranks by code point, null last: ranges of sources are numbered apart, then shifted by the sources before them.
    ranged = ws.save(totals.repartitionByRange(partitions(ws.spark), F.asc_nulls_last("_source")).withColumn("_part", F.spark_partition_id()))
    parts, before, offset = [], [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        parts.append(part)
        before.append(offset)
        offset += n
    shift = F.broadcast(ws.spark.createDataFrame(pa.table({"_part": pa.array(parts, pa.int32()), "_before": pa.array(before, pa.int64())})))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("_source"))) - 1 + F.col("_before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    weighed = ws.save(ranged.join(shift, "_part").select("_source", "source_size", weight.alias("_weight")))

    size, cap = F.col("source_size").cast("double"), F.col("source_size") * MAX_COPIES
    whole = SHARE * (weighed.agg(F.sum(size)).first()[0] or 0.0)
    level = 0.0
    while True:
        capped = F.col("_weight") * level > cap
        r = weighed.agg(F.sum(F.when(capped, cap)).alias("held"), F.sum(F.when(~capped, F.col("_weight"))).alias("free")).first()
        new = (whole - (r["held"] or 0.0)) / r["free"] if r["free"] else level
        if new <= level:
            return weighed.withColumn("target", F.least(F.col("_weight") * level, cap))
        level = new


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    size: words of the text, null or empty: 0. Sources in code point order, null last, weigh 5, 2, 1, repeating, and
    share SHARE of all words, none above MAX_COPIES times its own. taken is a whole multiple of size and at most
    MAX_COPIES times it; documents of size 0 take 0. Rows are told apart by id, then size; equal rows may swap places.
    A null id is an id like any other. Reruns agree, whatever the partitions. An empty table gives an empty result.
    Very long texts are documents like any other; other columns aren't read, whatever they are called.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col).cast("binary")).alias("size"))
    rows = ws.save(rows.withColumn("_at", F.xxhash64(F.lit(SEED), "doc_id", "size")))
    targets = source_targets(ws, rows)
    # The smallest documents of each source wait for landing. The window keeps LAND_DOCS rows a task before it shuffles.
    small = rows.where("size > 0").withColumn("_n", F.row_number().over(Window.partitionBy("_source").orderBy("size", "_at"))).where(F.col("_n") <= LAND_DOCS)
    edges = small.groupBy(F.col("_source").alias("_s")).agg(F.max(F.struct("size", "_at")).alias("_edge"))
    targets = ws.save(targets.join(edges, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    # Sources may be many, so they are joined, not collected; one source may have most rows, which AQE splits.
    wanted = rows.join(targets, rows["_source"].eqNullSafe(targets["_source"])).select(rows["doc_id"], rows["_source"], "size", "source_size", "target", "_at", (F.struct("size", "_at") < F.col("_edge")).alias("_waits"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(copies + 1e-12)
    state = ws.save(wanted.select("*", whole.alias("_whole"), F.when(F.col("size") > 0, F.greatest(copies - whole, F.lit(0.0))).otherwise(0.0).alias("_pi")))

    columns = ["doc_id", "_source", "size", "source_size", "target", "_whole", "_pi", "_at", "_waits"]
    schema = state.select(*columns).schema
    settled = []
    while True:
        undecided = state.where("_pi > 0 AND _pi < 1")
        blocks = undecided.groupBy("_source").agg(F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("_waits")) / block)).alias("_blocks"))
        most = blocks.agg(F.max("_blocks")).first()[0]
        settled.append(state.where("_pi <= 0 OR _pi >= 1").select(*columns))
        if most is None:
            break
        last = most == 1
        open_rows = (undecided if last else undecided.where("NOT _waits")).join(blocks.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        open_rows = open_rows.withColumn("_block", F.pmod(F.xxhash64("_at", F.lit(len(settled))), F.col("_blocks")))

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_at", "doc_id", "size"], kind="stable").reset_index(drop=True)
            sizes = pdf["size"].to_numpy(dtype="float64")
            pi = flight(pdf["_pi"].to_numpy(dtype="float64"), sizes)
            if last:
                pi = land(pi, sizes, float((pdf["_pi"] * sizes).sum()))
            return pdf[columns].assign(_pi=pi)

        moved = open_rows.select(*columns, "_block").groupBy("_source", "_block").applyInPandas(settle, schema)
        state = ws.save(moved if last else moved.unionByName(undecided.where("_waits").select(*columns)))
        if last:
            settled.append(state)
            break
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    return done.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", (F.col("size") * (F.col("_whole") + F.col("_pi").cast("long"))).cast("long").alias("taken"))
