"""The n-th row of each group against a sort, with ties, large numbers and small buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.operators import encode, selection


@pytest.fixture
def save(spark, tmp_path):
    n = iter(range(10_000))

    def write(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


ORDER = [("v", False), ("p", True), ("f", True)]


@pytest.mark.parametrize("values", ["spread", "ties", "equal", "heavy"])
def test_equals_a_sort(spark, save, monkeypatch, values):
    monkeypatch.setattr(selection, "RANKED", 5)
    monkeypatch.setattr(selection, "BUCKETS", 4)
    rnd = random.Random(values)
    draw = {"spread": rnd.random, "ties": lambda: rnd.randrange(3) / 4, "equal": lambda: 0.5, "heavy": lambda: 2.0 ** rnd.randrange(-40, 60)}[values]
    big = 2**61
    rows = [(g, draw(), big + rnd.randrange(50), rnd.randrange(4)) for g in range(3) for _ in range(120)] + [(7, 1.0, big, 0)]
    wanted = {0: 1, 1: 60, 2: 120, 7: 2}
    df = spark.createDataFrame(rows, "g int, v double, p long, f int").repartition(3)
    edges = save(selection.nth_rows(df, spark.createDataFrame(list(wanted.items()), "g int, n long"), "g", ORDER, save))
    kept = selection.first_rows(df, edges, "g", ORDER).collect()
    for g, n in wanted.items():
        own = sorted(((-v, p, f) for x, v, p, f in rows if x == g))
        want = [r for r in own if len(own) < n or r <= own[n - 1]]
        assert sorted((-r["v"], r["p"], r["f"]) for r in kept if r["g"] == g) == want
    assert {r["g"] for r in edges.collect()} == {0, 1, 2}


def test_groups_that_are_not_broadcast(spark, save, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_GROUPS", 0)
    rows = [(g, float(i), i, 0) for g in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, v double, p long, f int")
    edges = selection.nth_rows(df, spark.createDataFrame([(g, 10 * g + 1) for g in range(4)], "g int, n long"), "g", ORDER, save)
    assert sorted((r["g"], r["v"]) for r in edges.collect()) == [(g, 49.0 - 10 * g) for g in range(4)]


def test_batch_top_k_of_parts_equals_the_whole(spark, save):
    rng = np.random.default_rng(2)
    rows = [(f, p, i, 0, float(a)) for p in range(12) for i in range(6) for f, a in enumerate(np.round(rng.random(8), 1)) if a > 0.3]
    df = spark.createDataFrame(rows, "feature_id int, prompt_idx long, pos int, token_id int, act double")
    whole = encode.batch_top_k(df, 2, 4, save).collect()
    edges = encode.batch_top_k_edges(df, 2, 4, save)
    parts = [r for f in range(8) for r in encode.above_edges(df.where(F.col("feature_id") == f), edges, 4).collect()]
    assert sorted(whole) == sorted(parts)
    for b in range(3):
        own = sorted(((-a, p, i, f) for f, p, i, _, a in rows if p // 4 == b))
        n = 2 * len({(p, i) for _, p, i, _ in own})
        assert sorted((-r["act"], r["prompt_idx"], r["pos"], r["feature_id"]) for r in whole if r["batch_id"] == b) == own[:n]
    assert encode.batch_top_k(df.limit(0), 2, 4, save).count() == 0
