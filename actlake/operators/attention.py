"""Causal attention weights of chosen destinations, from queries and keys, over blocks of source positions.

A destination's weights are a softmax over all positions up to its own. Sources are met block by block: a running maximum
and a running sum that is rescaled when the maximum grows (online softmax) need no row of all scores, and a second
pass over the blocks writes the weights. Prompts are dealt to groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.operators.encode import matrix

#: Prompts of a group, about; sources of a block; destinations that are met with it at once.
GROUP, SOURCES, DESTS = 256, 1_024, 256


def softmax_blocks(q: np.ndarray, k: np.ndarray, dest: np.ndarray, scale: float) -> np.ndarray:
    """Weights [destination, source, head] of q [destination, head, width] over k [source, kv head, width]; 0 behind a destination."""
    heads, kv_heads = q.shape[1], k.shape[1]
    shared = heads // kv_heads
    top, total = np.full(q.shape[:2], -np.inf), np.zeros(q.shape[:2])

    def scores(start: int) -> np.ndarray:
        part = k[start : start + SOURCES]
        s = np.empty((len(q), len(part), heads))
        for h in range(heads):
            s[:, :, h] = q[:, h] @ part[:, h // shared].T * scale
        s[np.arange(start, start + len(part))[None, :] > dest[:, None]] = -np.inf
        return s

    for start in range(0, len(k), SOURCES):
        s = scores(start)
        new = np.maximum(top, s.max(axis=1))
        total = total * np.exp(top - new) + np.exp(s - new[:, None]).sum(axis=1)
        top = new
    return np.concatenate([np.exp(scores(start) - top[:, None]) / total[:, None] for start in range(0, len(k), SOURCES)], axis=1)


def causal_weights(queries: DataFrame, keys: DataFrame, heads: int, width: int, kv_heads: int | None = None, scale: float | None = None) -> DataFrame:
    """prompt_idx, dest, w (by source from 0 to dest, then head) of each query: what attribution.attribute() takes.

    queries: prompt_idx, dest, q (heads blocks of `width`), each destination once. keys: prompt_idx, pos (without gaps), k
    (kv_heads blocks). With fewer kv_heads than heads, each serves heads / kv_heads heads in turn. scale: 1 / sqrt(width) if
    left out. A query without keys has no row.
    """
    kv_heads, scale = kv_heads or heads, width**-0.5 if scale is None else scale
    if heads % kv_heads:
        raise ValueError("heads isn't a multiple of kv_heads")
    groups = max(1, -(-queries.agg(F.approx_count_distinct("prompt_idx")).first()[0] // GROUP))
    deal = lambda: F.pmod(F.xxhash64("prompt_idx"), F.lit(groups)).alias("group")

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        out_prompt, out_dest, out, sizes = [], [], [], [0]
        if len(asked) and len(given):
            prompts, pos = (given.column(c).to_numpy() for c in ("prompt_idx", "pos"))
            order = np.lexsort((pos, prompts))
            k = matrix(given.column("k").combine_chunks(), kv_heads * width)[order].reshape(-1, kv_heads, width)
            wanted, dest = (asked.column(c).to_numpy() for c in ("prompt_idx", "dest"))
            mine = np.lexsort((dest, wanted))
            q = matrix(asked.column("q").combine_chunks(), heads * width)[mine].reshape(-1, heads, width)
            wanted, dest = wanted[mine], dest[mine]
            for p in np.unique(wanted).tolist():
                (a, b), (i, j) = np.searchsorted(prompts[order], [p, p + 1]), np.searchsorted(wanted, [p, p + 1])
                for start in range(i, j if b > a else i, DESTS):
                    at = dest[start : min(start + DESTS, j)]
                    w = softmax_blocks(q[start : start + len(at)], k[a : a + int(at.max()) + 1], at, scale)
                    for d, row in zip(at.tolist(), w):
                        out.append(row[: d + 1].ravel())
                        sizes.append(len(out[-1]))
                    out_prompt += [p] * len(at)
                    out_dest += at.tolist()
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(out) if out else [], pa.float64()))
        return pa.table({"prompt_idx": pa.array(out_prompt, pa.int64()), "dest": pa.array(out_dest, pa.int32()), "w": lists})

    asked = queries.select(deal(), "prompt_idx", F.col("dest").cast("int").alias("dest"), "q")
    given = keys.join(queries.select("prompt_idx").distinct(), "prompt_idx", "left_semi").select(deal(), "prompt_idx", "pos", "k")
    return asked.groupBy("group").cogroup(given.groupBy("group")).applyInArrow(run, "prompt_idx long, dest int, w array<double>")
