"""Attention weights by blocks against a plain softmax, and attribution through them."""

import numpy as np
import pytest

from actlake.operators import attention, attribution


def plain(q, k, dest, scale):
    shared = q.shape[1] // k.shape[1]
    out = np.zeros((len(q), len(k), q.shape[1]))
    for a, d in enumerate(dest):
        for h in range(q.shape[1]):
            s = np.exp([scale * q[a, h] @ k[b, h // shared] for b in range(d + 1)])
            out[a, : d + 1, h] = s / s.sum()
    return out


@pytest.mark.parametrize("sources", [1, 3, 1024])
@pytest.mark.parametrize("kv_heads", [4, 2, 1])
def test_blocks_equal_a_whole_softmax(monkeypatch, sources, kv_heads):
    monkeypatch.setattr(attention, "SOURCES", sources)
    rng = np.random.default_rng(1)
    q, k, dest = rng.normal(size=(6, 4, 5)), rng.normal(size=(11, kv_heads, 5)), np.array([0, 3, 10, 5, 7, 1])
    got = attention.softmax_blocks(q, k, dest, 3.0)
    np.testing.assert_allclose(got, plain(q, k, dest, 3.0), atol=1e-12)
    np.testing.assert_allclose(got.sum(axis=1), 1.0)


def test_large_scores_do_not_overflow():
    q, k = np.full((1, 1, 1), 1e3), np.array([[[1.0]], [[2.0]], [[-5.0]]])
    assert attention.softmax_blocks(q, k, np.array([2]), 1.0)[0, :, 0].tolist() == [0.0, 1.0, 0.0]


def test_attribution_through_softmax(spark, monkeypatch):
    monkeypatch.setattr(attention, "GROUP", 2)
    monkeypatch.setattr(attention, "SOURCES", 3)
    monkeypatch.setattr(attention, "DESTS", 2)
    rng = np.random.default_rng(4)
    heads, kv, width, prompts = 4, 2, 3, {5: 7, 6: 1, 2**40: 4}
    q = {(p, i): rng.normal(size=heads * width) for p, n in prompts.items() for i in range(n)}
    k, v = ({key: rng.normal(size=kv * width) for key in q} for _ in range(2))
    w = rng.normal(size=(2, heads * width))
    targets = [(f, p, d) for f in range(2) for p, n in prompts.items() for d in {n - 1, n // 2}]
    frame = lambda x, name: spark.createDataFrame([(p, i, a.tolist()) for (p, i), a in x.items()], f"prompt_idx long, pos int, {name} array<double>")
    wanted = sorted({(p, d) for _, p, d in targets})
    queries = spark.createDataFrame([(p, d, q[p, d].tolist()) for p, d in wanted], "prompt_idx long, dest int, q array<double>")
    attn = attention.causal_weights(queries, frame(k, "k"), heads, width, kv, 2.0)
    own = {(r["prompt_idx"], r["dest"]): np.array(r["w"]).reshape(-1, heads) for r in attn.collect()}
    assert sorted(own) == wanted
    encoder = spark.createDataFrame([(f, w[f].tolist()) for f in range(2)], "feature_id int, w_enc array<double>")
    found = attribution.attribute(spark.createDataFrame(targets, "feature_id int, prompt_idx long, pos int"), attn, frame(v, "v"), encoder, heads, width, kv)
    got = sorted((r["feature_id"], r["prompt_idx"], len(r["dfa"]), tuple(np.round(r["dfa"], 9))) for r in found.collect())
    want = []
    for f, p, d in targets:
        a = plain(q[p, d].reshape(1, heads, width), np.array([k[p, i].reshape(kv, width) for i in range(prompts[p])]), [d], 2.0)[0]
        np.testing.assert_allclose(own[p, d], a[: d + 1], atol=1e-12)
        out = [sum(a[i, h] * (v[p, i].reshape(kv, width)[h // 2] @ w[f].reshape(heads, width)[h]) for h in range(heads)) for i in range(d + 1)]
        want.append((f, p, d + 1, tuple(np.round(out, 9))))
    assert got == sorted(want)


def test_no_queries_and_odd_heads(spark):
    queries = spark.createDataFrame([], "prompt_idx long, dest int, q array<double>")
    keys = spark.createDataFrame([(1, 0, [1.0, 2.0])], "prompt_idx long, pos int, k array<double>")
    assert attention.causal_weights(queries, keys, 2, 1).count() == 0
    with pytest.raises(ValueError):
        attention.causal_weights(queries, keys, 3, 1, 2)
