"""Exports that are stopped at any step: resumed and renamed."""

import json

import pytest
from pyspark.sql import functions as F

from actlake.sources import exports, sinks
from actlake.sources.exports import Export
from actlake.sources.folders import Folders
from actlake.sources.schemas import FEATURE

CONFIG = sinks.ExportConfig("old-model", "me", "r", "R", "u", "set", 3, "hook_resid_post")


@pytest.fixture(scope="module")
def rows(spark):
    """Six features in three batches."""
    one = lambda f: {"bin_min": 0.0, "bin_max": 1.0, "bin_contains": 0.5, "tokens": ["a", "b"], "values": [0.25 * f, 0.5], "qualifying_token_index": 1, "dfa_values": [], "dfa_maxValue": 0.0, "dfa_targetIndex": -1}
    made = [{"feature_index": f, "activations": [one(f)] * (f % 3)} for f in range(6)]
    return spark.createDataFrame(made, FEATURE).withColumn("batch_id", F.floor(F.col("feature_index") / 2).cast("int")).persist()


def content(spark, folder):
    own = Export(spark, folder)
    return {p: sorted(own.read(p).toJSON().collect()) for p in ("features", "activations")} | {h: [json.dumps(json.loads(r[0]), sort_keys=True) for r in spark.read.text(f"{folder}/{h}").collect()] for h in ("release", "model", "sourceset", "source")}


def test_batches_one_by_one_equal_one_run(spark, rows, tmp_path):
    once, parts = (f"file://{tmp_path}/{n}" for n in ("once", "parts"))
    assert Export(spark, once).write(rows, CONFIG, "2026-01-01") == [0, 1, 2]
    for upto in (0, 1, 2, 2):
        Export(spark, parts).write(rows.where(F.col("batch_id") <= upto), CONFIG, "2026-01-01")
    assert content(spark, once) == content(spark, parts)
    assert [len(Folders(spark).names(f"{parts}/features/batch_id={b}")) for b in range(3)] == [1, 1, 1]
    assert Export(spark, parts).write(rows, CONFIG, "2026-01-01") == []
    sizes = {b: (c["n_features"], c["n_activations"]) for b, c in Export(spark, parts).commits().items()}
    assert sizes == {0: (2, 1), 1: (2, 2), 2: (2, 3)}


def test_what_a_lost_run_wrote_is_not_read(spark, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/e"
    Export(spark, folder).write(rows.where("batch_id = 0"), CONFIG, "2026-01-01")
    lost = Export(spark, folder)
    add = lost._add
    monkeypatch.setattr(lost, "_add", lambda part, *more: add(part, *more) if part == "features" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lost.write(rows, CONFIG, "2026-01-01")
    assert Export(spark, folder).read("features").count() == 2
    Export(spark, folder).write(rows, CONFIG, "2026-01-01")
    assert Export(spark, folder).read("features").count() == 6 and spark.read.json(f"{folder}/features").count() == 6


def test_other_settings_replace_a_batch(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/e"
    Export(spark, folder).write(rows, CONFIG, "2026-01-01")
    assert Export(spark, folder).write(rows.where("batch_id = 1"), CONFIG, "2026-02-02") == [1]
    found = Export(spark, folder).read("features").groupBy("batch_id", "createdAt").count().orderBy("batch_id").collect()
    assert [tuple(r) for r in found] == [(0, "2026-01-01", 2), (1, "2026-02-02", 2), (2, "2026-01-01", 2)]


STEPS = ["model", "sourceset", "source", "features", "activations", "explanations", "release", "commits", "journal", "move", "switch", "clean"]


@pytest.mark.parametrize("fails, target", [(f, None) for f in ("model", "activations", "commits", "journal", "move", "clean")] + [(f, "new-model") for f in (None, "move", "switch")])
def test_a_rename_is_whole_or_absent(spark, rows, tmp_path, fails, target):
    folder = f"file://{tmp_path}/old-model"
    Export(spark, folder).write(rows, CONFIG, "2026-01-01")
    spark.createDataFrame([("old-model", 1), (None, 2)], "modelId string, index int").withColumn("batch_id", F.lit(0)).withColumn("commit", F.lit("c1")).write.partitionBy("batch_id", "commit").json(f"{folder}/explanations")
    old, seen = content(spark, folder), []

    def step(name):
        seen.append(name)
        if name == fails:
            raise RuntimeError(name)

    if fails:
        with pytest.raises(RuntimeError):
            exports.rename_model(spark, folder, "new-model", target, step)
    else:
        exports.rename_model(spark, folder, "new-model", target, step)
        assert sorted(seen) == sorted(STEPS)
    done = fails is None or STEPS.index(fails) > STEPS.index("journal")
    at = f"file://{tmp_path}/{target or 'old-model'}" if done else folder
    exports.recover(spark, at)
    assert sorted(p.name for p in tmp_path.iterdir()) == [at.rsplit("/", 1)[1]]
    new = {k: [x.replace("old-model", "new-model") for x in v] for k, v in old.items()}
    assert content(spark, at) == (new if done else old)
    assert sorted(r["modelId"] or "" for r in spark.read.json(f"{at}/explanations").collect()) == ["", "new-model" if done else "old-model"]


def test_a_taken_name_is_an_error(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/old-model"
    Export(spark, folder).write(rows, CONFIG, "2026-01-01")
    (tmp_path / "new-model").mkdir()
    with pytest.raises(FileExistsError):
        exports.rename_model(spark, folder, "new-model", "new-model")
