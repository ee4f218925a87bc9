"""Attribution of a feature's activation to source positions through attention.

out[dest, src, feature] = sum over heads of attn[head, dest, src] * (v[src, kv_head] . w_enc[feature, head]). Only the
destination with a prompt's largest activation is wanted, so the work is linear in the prompt's length. Prompts are
dealt to groups of bounded size; a group multiplies its values with the encoder as matrices and gives out the sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.operators.encode import Weights, matrix, passes

#: Prompts of a group, about.
GROUP = 256


def by_source(attn: DataFrame) -> DataFrame:
    """prompt_idx, dest, w (by source, then head, without gaps) from rows of one head each: prompt_idx, head, dest, src, w."""
    pairs = F.array_sort(F.collect_list(F.struct("src", "head", "w")))
    return attn.groupBy("prompt_idx", "dest").agg(F.transform(pairs, lambda x: x["w"]).alias("w"))


def attribute(targets: DataFrame, attn: DataFrame, values: DataFrame, encoder: DataFrame, heads: int, width: int, kv_heads: int | None = None) -> DataFrame:
    """feature_id, prompt_idx, dfa (by source position from 0) for each target.

    targets: feature_id, prompt_idx, pos. attn: as by_source() returns it. values: prompt_idx, pos (without gaps), v
    (kv_heads blocks of `width`). With fewer kv_heads than heads, each serves heads / kv_heads heads in turn. No
    features give no rows; an encoder of another length than heads * width is an error.
    """
    kv_heads = kv_heads or heads
    if heads % kv_heads:
        raise ValueError("heads isn't a multiple of kv_heads")
    spark = targets.sparkSession
    groups = max(1, -(-values.agg(F.approx_count_distinct("prompt_idx")).first()[0] // GROUP))  # a sketch a task, no shuffle of positions
    deal = lambda: F.pmod(F.xxhash64("prompt_idx"), F.lit(groups)).alias("group")
    asked = targets.groupBy("prompt_idx", F.col("pos").alias("dest")).agg(F.collect_list("feature_id").alias("features"))  # at most the features of a report
    asked = asked.join(attn, ["prompt_idx", "dest"]).select(deal(), "prompt_idx", "features", "w")
    given = values.select(deal(), "prompt_idx", "pos", "v")
    schema, out = "feature_id int, prompt_idx long, dfa array<double>", None

    def summed(shared: Broadcast) -> DataFrame:
        def run(asked: pa.Table, given: pa.Table) -> pa.Table:
            own = shared.value
            weights = own.w.reshape(kv_heads, heads // kv_heads, width, len(own.ids))
            prompts, pos = (given.column(c).to_numpy() for c in ("prompt_idx", "pos"))
            order = np.lexsort((pos, prompts))
            v = matrix(given.column("v").combine_chunks(), kv_heads * width)[order].reshape(-1, kv_heads, width) if len(given) else np.empty((0, kv_heads, width))
            wanted = asked.column("prompt_idx").to_numpy()
            begin, end = (np.searchsorted(prompts[order], wanted, side=side) for side in ("left", "right"))
            features, attn = asked.column("features").to_pylist(), asked.column("w").combine_chunks()
            offsets, attn = (attn.offsets.to_numpy(), attn.values.to_numpy()) if len(asked) else ((), ())
            place = {f: k for k, f in enumerate(own.ids.tolist())}
            ids, of, sums, sizes, last = [], [], [], [0], None
            for i in np.argsort(wanted, kind="stable").tolist():
                if wanted[i] != last:
                    last = wanted[i]
                    # [position, head, feature]: what each source of the prompt would give through each head.
                    gives = np.concatenate([v[begin[i] : end[i], h] @ w for h in range(kv_heads) for w in weights[h]]).reshape(heads, end[i] - begin[i], -1)
                known = [f for f in features[i] if f in place]
                a = attn[offsets[i] : offsets[i + 1]].reshape(-1, heads)
                sums.append((a.T[:, :, None] * gives[:, : len(a), [place[f] for f in known]]).sum(axis=0).T.ravel())
                ids += known
                of += [last] * len(known)
                sizes += [len(a)] * len(known)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(sums) if sums else [], pa.float64()))
            return pa.table({"feature_id": pa.array(ids, pa.int32()), "prompt_idx": pa.array(of, pa.int64()), "dfa": lists})

        return asked.groupBy("group").cogroup(given.groupBy("group")).applyInArrow(run, schema)

    for rows in passes(encoder.select("feature_id", "w_enc", F.lit(0.0).alias("b_enc")), []):
        own = Weights(rows)
        if own.w.shape[0] != heads * width:
            raise ValueError(f"encoder rows have {own.w.shape[0]} entries, not {heads} * {width}")
        part = summed(spark.sparkContext.broadcast(own))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def records(parts: DataFrame) -> DataFrame:
    """feature_id, prompt_idx, dfa_values (by source position, 3 decimals), dfa_max_value, dfa_target_index (the first maximum)."""
    lists = parts.select("feature_id", "prompt_idx", F.transform("dfa", lambda x: F.round(x, 3) + 0.0).alias("dfa_values"))
    return lists.withColumn("dfa_max_value", F.array_max("dfa_values")).withColumn("dfa_target_index", (F.array_position("dfa_values", F.col("dfa_max_value")) - 1).cast("int"))
