"""The command line over a small model's tables, written as a user would have them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.plans import cli
from actlake.sources import readers, sinks
from actlake.sources.exports import Export


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('model')}"
    rng = np.random.default_rng(11)
    d, vocab, features = 8, 30, 6
    rows = [(p, i, int(rng.integers(vocab)), rng.normal(size=d).tolist()) for p in range(25) for i in range(10)]
    spark.createDataFrame(rows, "prompt_idx long, pos int, token_id int, act array<float>").write.parquet(f"{path}/activations")
    w = rng.normal(size=(features, d))
    spark.createDataFrame([(f, w[f].tolist(), -0.5, 0.2) for f in range(features)], "feature_id int, w_enc array<double>, b_enc double, threshold double").write.parquet(f"{path}/encoder")
    spark.createDataFrame([(f, (2 * w[f]).tolist()) for f in range(features)], "feature_id int, w_dec array<double>").write.parquet(f"{path}/decoder")
    u = rng.normal(size=(vocab, d))
    spark.createDataFrame([(t, u[t].tolist()) for t in range(vocab)], "token_id int, w_u array<double>").write.parquet(f"{path}/unembed")
    spark.createDataFrame([(t, f"t{t}") for t in range(1, vocab)], "token_id int, token string").write.parquet(f"{path}/vocab")
    return path, rows, w, u


def arguments(path, out, *more):
    tables = [x for t in ("activations", "unembed", "vocab") for x in (f"--{t}", f"{path}/{t}")]
    return [*tables, "--out", out, "--model-id", "demo", "--sae-set", "set", "--batch-size", "3", "--top", "4", "--intervals", "2", "--per-interval", "2", "--logit-rows", "2", "--table-rows", "2", *more]


def test_dashboards_of_own_tables(spark, model, tmp_path):
    path, rows, w, u = model
    own = ["--encoder", f"{path}/encoder", "--decoder", f"{path}/decoder", "--heads", "2"]
    folder = cli.main(arguments(path, f"file://{tmp_path}/out", *own, "--start-batch", "1"))
    assert sinks.batch_ids(spark, f"{folder}/batches") == [1]
    export = ["--creator-id", "me", "--release-id", "r", "--release-title", "R", "--url", "u", "--created-at", "2026-01-01"]
    assert cli.main(arguments(path, f"file://{tmp_path}/out", *own, *export)) == folder
    assert sinks.batch_ids(spark, f"{folder}/batches") == [0, 1]
    found = {f["feature_index"]: f for r in readers.written_batches(spark, f"{folder}/batches").collect() for f in r["features"]}
    assert sorted(found) == list(range(6))
    x = np.array([np.float32(r[3]).astype(float) for r in rows])
    acts = np.maximum(np.round(x @ w.T - 0.5, 6), 0)
    logits = 2 * w @ u.T
    for f, got in found.items():
        names = [f"t{t}" if t else "UNK" for t in np.argsort(-logits[f], kind="stable")[:2]]
        assert got["pos_str"] == names and got["pos_values"] == pytest.approx(sorted(logits[f])[::-1][:2], abs=1e-5)
        assert got["frac_nonzero"] == pytest.approx((acts[:, f] > 0).mean(), abs=1e-5) and sum(got["freq_hist_data_bar_heights"]) == (acts[:, f] > 0).sum()
        assert got["correlated_features_pearson"][0] == pytest.approx(sorted([np.corrcoef(acts[:, f], acts[:, g])[0, 1] if g != f else 0.0 for g in range(f // 3 * 3, f // 3 * 3 + 3)])[-1], abs=1e-4)
        best = got["activations"][0]
        assert best["bin_min"] == -1 and best["bin_max"] == pytest.approx(acts[:, f].max(), abs=1e-3) and len(best["tokens"]) == 9 and len(got["decoder_weights_dist"]) == 2
        assert best["values"][best["qualifying_token_index"]] == pytest.approx(acts[:, f].max(), abs=1e-3) or best["qualifying_token_index"] == -1
        assert got["n_prompts_total"] == 25 and got["n_tokens_in_prompt"] == 10
    assert sorted(r["index"] for r in Export(spark, f"{folder}/export").read("features").collect()) == list(range(6))  # of both runs
    assert spark.read.json(f"{folder}/export/model").first()["id"] == "demo"


def test_vector_sets_and_masks(spark, model, tmp_path):
    path, _, w, _ = model
    (tmp_path / "set.json").write_text(json.dumps({"vectors": w[:2].tolist(), "config": {"vector_names": ["one", "two"]}}))
    more = ["--vectors", f"file://{tmp_path}/set.json", "--ignore-positions", "0", "--high-norm", "1.2", "--prompts", "10", "--before", "2", "--after", "1"]
    folder = cli.main(arguments(path, f"file://{tmp_path}/out", *more))
    found = readers.written_batches(spark, f"{folder}/batches").select(F.explode("features").alias("f")).select("f.*").collect()
    assert [r["vector"] for r in sorted(found, key=lambda r: r["feature_index"])] == [pytest.approx(v) for v in w[:2].tolist()]
    assert all(len(a["tokens"]) <= 4 and a["qualifying_token_index"] >= -1 for r in found for a in r["activations"]) and {r["n_prompts_total"] for r in found} == {10}


def test_missing_weights_are_an_error(model, tmp_path):
    with pytest.raises(SystemExit):
        cli.main(arguments(model[0], f"file://{tmp_path}/out"))


EXPORT = ["--creator-id", "me", "--release-id", "r", "--release-title", "R", "--url", "u", "--created-at", "2026-01-01"]


def exported(spark, folder):
    """Rows of an export as text, by table."""
    own = Export(spark, f"{folder}/export")
    return {part: sorted(own.read(part).toJSON().collect()) for part in ("features", "activations")} | {h: spark.read.text(f"{folder}/export/{h}").collect() for h in ("release", "model", "sourceset", "source")}


def test_batch_top_k_ranks_all_features_whatever_the_batches(spark, model, tmp_path):
    """One run of all features equals runs batch by batch, with other sizes of batches, and a rerun changes nothing."""
    path, rows, w, u = model
    own = ["--encoder", f"{path}/encoder", "--decoder", f"{path}/decoder", "--batch-top-k", "1", "--prompts-per-batch", "10"]
    cases = {"whole": [["--batch-size", "6"]], "parts": [["--end-batch", "0"], ["--start-batch", "1"], []], "small": [["--batch-size", "2", "--start-batch", "1"], ["--batch-size", "2"]]}
    seen = {}
    for name, runs in cases.items():
        for more in runs:
            folder = cli.main([*arguments(path, f"file://{tmp_path}/{name}", *own, *EXPORT), *more])
        found = readers.written_features(spark, f"{folder}/batches").collect()
        seen[name] = {r["feature_index"]: (r["frac_nonzero"], r["freq_hist_data_bar_heights"], r["activations"]) for r in found}
        if name == "parts":
            parts = exported(spark, folder)
            cli.main(arguments(path, f"file://{tmp_path}/{name}", *own, *EXPORT))
            assert exported(spark, folder) == parts and len(parts["features"]) == 6
    assert seen["whole"] == seen["parts"] == seen["small"]
    x = np.array([np.float32(r[3]).astype(float) for r in rows])
    acts, prompt = np.maximum(np.round(x @ w.T - 0.5, 6), 0), np.array([r[0] for r in rows])
    kept = np.zeros(6)
    for batch in range(3):
        part = acts[prompt // 10 == batch]
        least = np.sort(part[part > 0])[::-1][: (part > 0).any(axis=1).sum()][-1]
        kept += (part >= least).sum(axis=0)
    assert {f: sum(v[1]) for f, v in seen["whole"].items()} == dict(enumerate(kept))


def test_no_feature_is_active_at_an_outlier(spark, model, tmp_path):
    """With a positive bias a zeroed position would fire."""
    path, rows, w, _ = model
    spark.read.parquet(f"{path}/encoder").withColumn("b_enc", F.lit(0.5)).write.parquet(f"file://{tmp_path}/encoder")
    folder = cli.main(arguments(path, f"file://{tmp_path}/out", "--encoder", f"file://{tmp_path}/encoder", "--decoder", f"{path}/decoder", "--high-norm", "1.1", "--prompts-per-batch", "25"))
    x = np.array([np.float32(r[3]).astype(float) for r in rows])
    norms = np.round(np.sqrt((x * x).sum(axis=1)), 6)
    live = norms <= 1.1 * np.sort(norms)[(len(norms) - 1) // 2]
    acts = np.maximum(np.round(x @ w.T + 0.5, 6), 0) * live[:, None]
    assert 0 < live.sum() < len(live)
    for r in readers.written_features(spark, f"{folder}/batches").collect():
        f = r["feature_index"]
        assert sum(r["freq_hist_data_bar_heights"]) == (acts[:, f] > 0).sum() and r["frac_nonzero"] == pytest.approx((acts[:, f] > 0).mean(), abs=1e-5)
        y = x * live[:, None]
        assert r["correlated_neurons_pearson"][0] == pytest.approx(max(np.corrcoef(acts[:, f], y[:, i])[0, 1] for i in range(8)), abs=1e-4)
