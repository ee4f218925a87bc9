"""The data sources: files chosen by filters before they are opened, rows as written."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from actlake.sources import datasource


def test_batches_by_number(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for n in (0, 2, 10):
        (tmp_path / f"batch-{n}.json").write_text(json.dumps({"model_id": "m", "layer": "1", "features": [{"feature_index": n, "pos_str": ["a", None], "pos_values": [1.5, None], "activations": [{"tokens": ["x"], "values": [0.5]}]}]}))
    (tmp_path / "batch-x.json").write_text("not one")
    datasource.register(spark)
    df = spark.read.format("dashboard_batches").load(folder)
    assert [(r["batch_id"], r["features"][0]["feature_index"]) for r in df.orderBy("batch_id").collect()] == [(0, 0), (2, 2), (10, 10)]
    first = df.where("batch_id = 2").first()
    assert first["features"][0]["pos_values"] == [1.5, None] and first["features"][0]["activations"][0]["values"] == [0.5] and first["sae_set"] is None
    (tmp_path / "batch-0.json").write_text("broken")  # not opened where it isn't wanted
    assert df.where("batch_id IN (2, 10)").count() == 2 and df.where("batch_id > 1 AND model_id = 'm'").count() == 2 and df.where("batch_id = 7").count() == 0
    reader = datasource.BatchReader(folder)
    assert list(reader.pushFilters([GreaterThan(("batch_id",), 1), EqualTo(("model_id",), "m")])) == [EqualTo(("model_id",), "m")]
    assert [p.batch_id for p in reader.partitions()] == [2, 10]


def test_no_batches_is_an_error(spark, tmp_path):
    datasource.register(spark)
    with pytest.raises(Exception, match="batch-"):
        spark.read.format("dashboard_batches").load(f"file://{tmp_path}").collect()


def test_matrices_by_stretches(spark, tmp_path, monkeypatch):
    folder, rng = f"file://{tmp_path}", np.random.default_rng(1)
    x = {"a": rng.normal(size=(10, 3)).astype(np.float32), "b": rng.normal(size=(4, 3)).astype(np.float32)}
    rows = [(s, i, v.tolist()) for s, m in x.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "name string, row long, x array<float>").repartition(3)
    assert datasource.write_shards(df, "name", "x", folder) == ["a", "b"] == datasource.write_shards(df, "name", "x", folder)
    np.testing.assert_array_equal(np.load(tmp_path / "a.npy"), x["a"])
    datasource.register(spark)
    found = spark.read.format("array_shards").load(folder)
    assert sorted((r["shard"], r["row"], r["x"]) for r in found.collect()) == sorted((s, i, v) for s, i, v in rows)
    assert [(r["shard"], r["row"]) for r in found.where("shard = 'a' AND row > 7").orderBy("row").collect()] == [("a", 8), ("a", 9)]
    monkeypatch.setattr(datasource, "ROWS", 3)
    for filters, want in (([], [0, 3, 6, 9, 0, 3]), ([EqualTo(("shard",), "a"), GreaterThan(("row",), 5)], [6, 9]), ([In(("row",), (4, 9))], [3, 9]), ([LessThanOrEqual(("row",), 2)], [0, 0]), ([EqualTo(("row",), 50)], [0])):
        reader = datasource.ShardReader(folder)
        assert list(reader.pushFilters(filters)) == []
        assert [p.start for p in reader.partitions()] == want
    assert spark.read.format("array_shards").load(f"file://{tmp_path}/none").count() == 0


def test_written_batches_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(f, f // 2, ["t"], [0.5 * f]) for f in range(5)], "feature_index int, batch_id int, pos_str array<string>, pos_values array<double>")
    assert datasource.write_batch_files(rows, {"model_id": "m", "layer": "0"}, f"file://{tmp_path}") == ["batch-0.json", "batch-1.json", "batch-2.json"]
    datasource.register(spark)
    found = spark.read.format("dashboard_batches").load(f"file://{tmp_path}").select("batch_id", F.explode("features").alias("f"))
    assert sorted((r["batch_id"], r["f"]["feature_index"], r["f"]["pos_values"]) for r in found.collect()) == [(f // 2, f, [0.5 * f]) for f in range(5)]
