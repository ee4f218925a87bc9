"""Correlations that grow by batches, and over all features in blocks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.operators import corr, encode
from actlake.sources.folders import Folders
from actlake.streaming.correlation import CorrelationState, correlate_stream


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(300, 6)), rng.normal(size=(9, 6))
    w[8] = w[0] + 0.01 * w[8]
    acts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "prompt_idx long, act array<double>").repartition(4).persist()
    encoder = spark.createDataFrame([(f, w[f].tolist(), -0.2, 0.0) for f in range(9)], "feature_id int, w_enc array<double>, b_enc double, threshold double")
    return acts, encoder, x, np.maximum(np.round(x @ w.T - 0.2, 6), 0)


@pytest.fixture
def save(spark, tmp_path):
    n = iter(range(1000))

    def write(df):
        path = f"file://{tmp_path}/saved/{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def rows(sums):
    return sorted(tuple(round(v, 7) for v in r) for r in sums.collect())


def test_batches_in_any_order_equal_one_pass(spark, data, tmp_path):
    acts, encoder, x, h = data
    state = CorrelationState(spark, f"file://{tmp_path}/state", ["feature_id", "idx"])
    assert state.sums() is None and state.batches() == []
    parts = {f"b{i}": corr.neuron_sums(acts.where(F.col("prompt_idx") % 3 == i), encoder) for i in range(3)}
    whole = rows(corr.neuron_sums(acts, encoder))
    for n, name in enumerate(("b2", "b0", "b2", "b1")):
        assert state.add(name, parts[name]) == (n != 2)
        if n == 1:
            before = rows(state.sums())
            state.compact()
            assert rows(state.sums()) == before
    state.compact()
    state.compact()
    assert rows(state.sums()) == whole and state.batches() == ["b0", "b1", "b2"]
    assert not state.add("b1", parts["b1"])
    assert Folders(spark).names(state.folder) == ["gen=1"]
    found = {(r["feature_id"], r["idx"]): r["pearson"] for r in corr.finalise(state.sums()).collect()}
    assert found[3, 2] == pytest.approx(np.corrcoef(h[:, 3], x[:, 2])[0, 1], abs=1e-5)
    with pytest.raises(ValueError):
        state.add("a/b", parts["b0"])


def test_a_stopped_merge_changes_nothing(spark, data, tmp_path):
    acts, encoder, *_ = data
    state = CorrelationState(spark, f"file://{tmp_path}/state", ["feature_id", "idx"])
    for i in range(2):
        state.add(f"b{i}", corr.neuron_sums(acts.where(F.col("prompt_idx") % 2 == i), encoder))
    whole, remove, state.tidy = rows(state.sums()), state.tidy, lambda: None  # stopped before it removes anything
    state.compact()
    Folders(spark).make(f"{state.folder}/new-lost")
    again = CorrelationState(spark, state.folder, state.by)
    assert rows(again.sums()) == whole and again.batches() == ["b0", "b1"]
    remove()
    assert Folders(spark).names(state.folder) == ["gen=0"] and rows(again.sums()) == whole


def test_a_stream_equals_one_pass(spark, data, tmp_path):
    acts, encoder, *_ = data
    acts.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    state = CorrelationState(spark, f"file://{tmp_path}/state", ["feature_id", "idx"])
    for _ in range(2):  # the second run finds nothing new
        correlate_stream(stream, lambda part: corr.neuron_sums(part, encoder), state, f"file://{tmp_path}/checkpoint", every=2).awaitTermination()
    assert rows(state.sums()) == rows(corr.neuron_sums(acts, encoder))


@pytest.mark.parametrize("block", [2, 4, 100])
def test_global_top_over_blocks(spark, data, save, block):
    acts, encoder, _, h = data
    got = {}
    for r in corr.global_top(acts, encoder, 300, 3, save, block=block).collect():
        got.setdefault(r["x_id"], []).append((r["rank"], r["y_id"], r["pearson"]))
    c = np.corrcoef(h.T)
    np.fill_diagonal(c, 0.0)
    for f in range(9):
        want = sorted(range(9), key=lambda g: (-round(c[f, g], 5), g))[:3]
        assert [(r, y) for r, y, _ in sorted(got[f])] == list(zip((1, 2, 3), want))
        assert [v for *_, v in sorted(got[f])] == pytest.approx([c[f, g] for g in want], abs=1e-4)
    assert corr.global_top(acts, encoder.limit(0), 300, 3, save).count() == 0


def test_blocks_that_cannot_matter_are_left_out(spark, save, monkeypatch):
    """Two halves of features, each active on positions of its own: their blocks are never multiplied."""
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(size=(200, 4))) * np.repeat([[1, 1, 0, 0], [0, 0, 1, 1]], 100, axis=0)
    acts = spark.createDataFrame([(v.tolist(),) for v in x], "act array<double>").coalesce(1).repartitionByRange(2, F.col("act")[0])
    encoder = spark.createDataFrame([(f, [float(f == i) for i in range(4)], 0.0, 0.0) for f in range(4)], "feature_id int, w_enc array<double>, b_enc double, threshold double")
    seen, collect = [], corr.Weights.__init__
    monkeypatch.setattr(corr.Weights, "__init__", lambda self, rows, least=False: (seen.append([r["feature_id"] for r in rows]), collect(self, rows, least))[1])
    found = corr.global_top(acts, encoder, 200, 1, save, block=2)
    assert [0, 1, 2, 3] not in seen[1:] and {(r["x_id"], r["y_id"]) for r in found.collect()} <= {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)}


def test_moments_and_output_matrix(spark):
    rng = np.random.default_rng(6)
    x, d = rng.normal(size=(50, 4)), rng.normal(size=(3, 4))
    vectors = spark.createDataFrame([(v.tolist(),) for v in x], "x array<float>").repartition(5)
    moments = encode.second_moments(vectors, "x")
    got = np.array([r["row"] for r in moments.orderBy("i").collect()])
    np.testing.assert_allclose(got, x.astype(np.float32).astype(float).T @ x.astype(np.float32) / 50, atol=1e-6)
    decoder = spark.createDataFrame([(f, d[f].tolist()) for f in range(3)], "feature_id int, w_dec array<double>")
    w = rng.normal(size=(4, 2))
    w_out = spark.createDataFrame([(i, w[i].tolist()) for i in range(4)], "i long, row array<double>")
    through = [r["resid_dir"] for r in encode.through_output(decoder, w_out).orderBy("feature_id").collect()]
    np.testing.assert_allclose(through, d @ w, atol=1e-6)


def test_logit_histograms_equal_those_of_all_logits(spark, save):
    from actlake.operators import stats

    rng = np.random.default_rng(7)
    decoder = spark.createDataFrame([(f, v) for f, v in enumerate([[1.0, 0.5], [0.0, 0.0], rng.normal(size=2).tolist()])], "feature_id int, w_dec array<double>")
    unembed = spark.createDataFrame([(t, rng.normal(size=2).tolist()) for t in range(90)], "token_id int, w_u array<double>").repartition(4)
    want = stats.histogram(encode.logit_lens(decoder, unembed), "feature_id", "logit", 10)
    assert sorted(encode.logit_histogram(decoder, unembed, 10, save).collect()) == sorted(want.select("feature_id", "bin", "height", "bar_value").collect())
