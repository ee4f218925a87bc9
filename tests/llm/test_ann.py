import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, q, k):
    own = {i: np.asarray(x, dtype=np.float64) for i, x in rows}
    scores = [(-float((own[i] * own[q]).sum()), i) for i in own if i != q]
    return sorted(scores)[:k]


def clean(rows):
    return [(i, [float(np.float32(y)) for y in x]) for i, x in rows if x and all(y is not None and np.isfinite(y) for y in x) and any(x)]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(1200, 64)))]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    rows = clean(rows)
    hit = 0
    for q in range(0, 1200, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 21)) and [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        want = dict((i, -s) for s, i in brute(rows, q, 1200))
        assert all(want[i] == pytest.approx(s, abs=1e-12) for _, i, s in own)
        hit += len({i for _, i, _ in own} & {i for _, i in brute(rows, q, 20)})
    assert hit / 1200 >= 0.9


def test_ties_lengths_and_unusable_vectors(spark, monkeypatch):
    """A vector that a third of the rows share, vectors of many lengths, and vectors that take no part; small blocks."""
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.0, -1.0] if i % 3 == 0 else (rng.normal(size=4) * rng.integers(1, 4)).tolist()) for i in range(90)]
    rows += [(90, None), (91, [0.0] * 4), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan"), 1.0, 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0, 1.0]), (100, [0.0] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    known = clean(rows)
    for q in (0, 20, 40, 60, 80):
        own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        want = brute(known, q, 10)
        assert [i for i, _ in own] == [i for _, i in want]
    assert {r["query_id"] for r in got} == {0, 20, 40, 60, 80}


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1]), (1, [0.5, 0.1])], SCHEMA)
    assert [(r["vec_id"], r["rank"]) for r in ann.search(df, F.col("vec_id") == 0).collect()] == [(1, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def whole(rows, got, queries, k=20):
    """Each query has its k rows with exact scores; the share of the true k nearest."""
    own = {i: np.float32(x).astype(np.float64) for i, x in rows}
    ids, m = np.array(list(own)), np.array(list(own.values()))
    hit = 0
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q in queries:
        scores = (m * own[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        assert len(found[q]) == len(order) and all(found[q][i] == pytest.approx((own[i] * own[q]).sum(), rel=1e-9, abs=1e-9) for i in found[q])
        hit += len(set(found[q]) & set(ids[order].tolist())) / len(order)
    return hit / len(queries)


def unit(rng, n):
    x = rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_small_table_is_whole(spark):
    rows = [(i, x.tolist()) for i, x in enumerate(unit(np.random.default_rng(3), 21))]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect()
    assert whole(rows, got, range(21)) == 1


@pytest.mark.parametrize("lengths", ["one long", "spread"])
def test_lengths_far_apart(spark, lengths):
    rng = np.random.default_rng(4)
    x = unit(rng, 4000)
    if lengths == "one long":
        x[7] *= 100
    else:
        x *= np.exp(rng.normal(size=(4000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert whole(rows, got, range(0, 4000, 20)) >= 0.95


def test_queries_without_near_vectors(spark, monkeypatch):
    """Hashed vectors that all lie away from the query: it is compared with all."""
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(5)
    x = unit(rng, 300)
    x[:, 0] = np.abs(x[:, 0]) + 1
    x[0] = -x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert whole(rows, got, [0]) == 1


def test_ties_at_the_edge_of_a_block(spark):
    """95 different vectors of one score behind five nearer ones: the smallest ids."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5 if i < 96 else 0.625, float(i % 2 * 2 - 1) * i / 128]) for i in range(1, 101)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [96, 97, 98, 99, 100, *range(1, 16)]


def test_a_thousand_equal_products(spark, monkeypatch):
    """Different vectors whose inner products with the query are one number: exactly the smallest ids, in any blocks."""
    monkeypatch.setattr(ann, "BLOCK", 97)
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0])]
    for i in rng.permutation(np.arange(1, 1201)).tolist():
        rows.append((i, [0.5 if i % 6 else 0.75, float(rng.integers(-64, 64)) / 128, float(rng.integers(-64, 64)) / 128]))
    got = ann.search(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") == 0, k=500, tables=4, probes=27, width=2.0).collect()
    want = brute(clean(rows), 0, 500)
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]


def test_one_vector_of_very_many_queries(spark, monkeypatch):
    from actlake.operators import spread

    monkeypatch.setattr(spread, "HOT_ROWS", 20)
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 7 + 1), 1.0]) for i in range(200)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.lit(True), k=5).collect()
    known = clean(rows)
    for q in range(0, 200, 17):
        own = [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert own == [(i, -s) for s, i in brute(known, q, 5)]


def test_unit_vectors_share_one_band(spark):
    """Lengths that differ from 1 by rounding only; a few vectors are hashed like many, and recall holds at each size."""
    for n in (150, 500, 2000):
        rows = [(i, x.tolist()) for i, x in enumerate(unit(np.random.default_rng(n), n))]
        df = spark.createDataFrame(rows, SCHEMA)
        assert ann.usable(df, "vec_id", "embedding").select(F.round(F.log("_len") / F.log(F.lit(ann.BAND)))).distinct().count() == 1
        got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
        assert whole(rows, got, range(0, n, 20)) >= 0.9


def test_no_queries(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 40)]
    assert ann.search(spark.createDataFrame(rows, SCHEMA), F.lit(False)).count() == 0


def test_registered_query_recall(spark):
    """The whole shared table, through hashes only."""
    from actlake.llm import registry

    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = registry.queries()["op8_ann_search"](spark, sf_dir)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert 0.9 <= whole(rows, out.collect(), [i for i, _ in rows if i % 20 == 0]) <= 1
