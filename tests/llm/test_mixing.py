import numpy as np
import pytest

from actlake.llm import mixing


def targets_brute(sizes):
    """sizes: {source: words}; None last."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, fixed = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2 * sizes[s]
            left -= fixed[s]
            free.remove(s)
    return fixed


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    pi, sizes = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    out = mixing.flight(pi, sizes)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert out.sum() == pytest.approx(pi.sum()) and (out * sizes).sum() == pytest.approx((pi * sizes).sum())


def test_flight_of_equal_sizes_and_few():
    out = mixing.flight(np.full(10, 0.3), np.ones(10))
    assert out.sum() == pytest.approx(3.0)
    assert mixing.flight(np.array([0.5]), np.array([3.0])).tolist() == [0.5]


def test_landing_meets_the_total():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60):
        start, sizes = rng.random(n), rng.integers(1, 500, n).astype(float)
        out = mixing.land(mixing.flight(start, sizes), sizes, (start * sizes).sum())
        assert set(out) <= {0.0, 1.0} and abs(out.sum() - start.sum()) <= 3
        assert abs((out * sizes).sum() - (start * sizes).sum()) <= (sizes.max() if n < 60 else 10)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(odd_rows) and mixing.mix(no_docs).count() == 0
    sizes = {}
    for _, t, _, s in odd_rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = targets_brute(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)


def test_totals_and_reruns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}" if i % 3 else "hot") for i, n in enumerate(rng.integers(1, 60, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(docs, block=200).collect()
    again = mixing.mix(docs.repartition(7), block=200).collect()
    assert sorted(first) == sorted(again)
    taken, target = {}, {}
    for r in first:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(len(t.split()) for _, t, _ in rows))


def test_landing_finds_the_nearest_subset():
    """All subsets of up to ten documents, of even and of heavy-tailed sizes."""
    rng = np.random.default_rng(9)
    for trial in range(60):
        n = int(rng.integers(1, 11))
        sizes = np.floor(np.exp(rng.normal(4, 2, n))).clip(1)
        start = rng.random(n)
        wanted = float((start * sizes).sum())
        out = mixing.land(mixing.flight(start, sizes), sizes, wanted)
        sums = [sum(sizes[i] for i in range(n) if way >> i & 1) for way in range(2**n)]
        assert set(out) <= {0.0, 1.0}
        assert abs((out * sizes).sum() - round(wanted)) == pytest.approx(min(abs(s - round(wanted)) for s in sums), abs=1.0)


def test_nearest_turns():
    rng = np.random.default_rng(10)
    for _ in range(200):
        turns = [int(t) for t in rng.integers(-30, 30, rng.integers(1, 9)) if t]
        off = int(rng.integers(-100, 100))
        got = mixing.nearest_turns(turns, off)
        best = min(abs(off - sum(t for i, t in enumerate(turns) if way >> i & 1)) for way in range(2 ** len(turns)))
        assert abs(off - sum(turns[i] for i in got)) == best


def test_heavy_tailed_sizes(spark):
    """Sources of a few and of many documents whose sizes span four orders, one of them most of its source: as near as the sizes allow."""
    rng = np.random.default_rng(6)
    sizes = np.floor(np.exp(rng.normal(3.5, 1.8, 900))).clip(1, 8000).astype(int)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 40 if i < 800 else 0}") for i, n in enumerate(sizes)]
    taken, target, own = {}, {}, {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        own.setdefault(r["source"], []).append(r["size"])
    for s, wanted in target.items():
        whole = sum(own[s]) * int(wanted / sum(own[s]) + 1e-12)
        reach = 1
        for n in own[s]:
            reach |= reach << n
        best = min(abs(whole + k - wanted) for k in range(reach.bit_length()) if reach >> k & 1)
        assert abs(taken[s] - wanted) <= best + 1, (s, taken[s], wanted, sorted(own[s]))
