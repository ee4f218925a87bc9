"""Literal fixtures and invariants of the operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.functions import text as tx
from actlake.functions import vectors as v
from actlake.operators import corr, encode, prompt_scores, prompts, sequences, stats, topk
from actlake.sources import readers, sinks
from actlake.streaming.incremental import running_stats, windowed_values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_top_k_largest_and_smallest(spark):
    df = spark.createDataFrame([(0, i, i + 1.0) for i in range(10)], "g int, i int, val double")
    assert [r["val"] for r in topk.top_k(df, ["g"], [F.desc("val")], 3).orderBy("rank").collect()] == [10, 9, 8]
    assert [r["i"] for r in topk.top_k(df, ["g"], [F.asc("val")], 3).orderBy("rank").collect()] == [0, 1, 2]
    assert topk.top_k(df, ["g"], [F.desc("val")], 50).count() == 10


def test_grid_and_reverse_quantile(spark):
    grid = stats.quantile_grid()
    assert grid[0] == 0.0 and grid[-1] == 1.0 and len(grid) == 2351 and grid == sorted(grid)
    label, decimals = stats.reverse_quantile(F.lit(2.5), F.array(*map(F.lit, [0.0, 1.0, 2.0, 3.0])), [0.0, 0.5, 0.96, 0.999])
    assert (one(spark, label), one(spark, decimals)) == (0.999, 5)


def test_fold_decoder_norm_closed_form(spark):
    enc = spark.createDataFrame([(0, [2.0] * 5, 1.0)], "feature_id int, w_enc array<double>, b_enc double")
    dec = spark.createDataFrame([(0, [3.0] * 5)], "feature_id int, w_dec array<double>")
    assert encode.fold_decoder_norm(enc, dec).first()["w_enc"][0] == pytest.approx(2 * 45**0.5)


def test_encode_of_a_subset_is_a_slice(spark):
    rng = np.random.default_rng(0)
    acts = spark.createDataFrame([(p, i, 0, rng.normal(size=8).tolist()) for p in range(3) for i in range(4)], "prompt_idx long, pos int, token_id int, act array<double>")
    w = spark.createDataFrame([(f, rng.normal(size=8).tolist(), 0.1, 0.2) for f in range(6)], "feature_id int, w_enc array<double>, b_enc double, threshold double")
    full = encode.encode(acts, w, keep="all")
    part = encode.encode(acts, w.where("feature_id IN (1, 4)"), keep="all")
    assert sorted(part.collect()) == sorted(full.where("feature_id IN (1, 4)").collect())
    assert encode.encode(acts, w, keep="threshold").where("act <= 0.2").isEmpty()
    assert encode.encode(acts, w.limit(0)).count() == 0


def test_pearson_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = np.abs(rng.normal(size=(2, 50)))
    rows = [(f, i, 0, float(s[i])) for f, s in ((0, x), (1, y)) for i in range(50)]
    acts = spark.createDataFrame(rows, "feature_id int, prompt_idx long, pos int, act double")
    found = {(r["x_id"], r["y_id"]): r["pearson"] for r in corr.feature_pairs(acts, None, 50).collect()}
    assert found[(0, 1)] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-5) and found[(0, 0)] == 0.0


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(0, 2.0)] * 3, "feature_id int, x double")
    heights = [r["height"] for r in stats.histogram(df, "feature_id", "x", 5).orderBy("bin").collect()]
    assert heights == [0, 0, 3, 0, 0]


def test_affixes_keep_length_or_fail(spark):
    tokens = F.array(*map(F.lit, range(8)))
    assert one(spark, prompts.with_affixes(tokens, [90], [91, 92])) == [0, 90, 1, 2, 3, 4, 91, 92]
    with pytest.raises(Exception, match="longer than the prompt"):
        one(spark, prompts.with_affixes(F.array(F.lit(1)), [2, 3], []))


def test_text_functions(spark):
    assert one(spark, tx.hook_layer(F.lit("blocks.5.hook_resid_post"))) == 5
    assert one(spark, tx.hook_point(F.lit("blocks.7.attn.hook_pattern"))) == "attn.hook_pattern"
    assert one(spark, tx.hook_layer(F.lit("model.layers.12.mlp"))) == 12
    assert one(spark, tx.hook_layer(F.lit("nothing"))) is None
    assert one(spark, tx.clean_token(F.lit("Ġdog"))) == " dog"
    assert one(spark, tx.to_html(F.lit("<a>"))) == "&lt;a&gt;"
    assert one(spark, tx.from_html(F.lit("&lt;a&gt;"))) == "<a>"
    assert [one(spark, tx.cold_warm_colour(F.lit(x))) for x in (-2.0, 0.0, 1.0)] == ["#0000ff", "#ffffff", "#ff0000"]
    assert one(spark, tx.warm_colour(F.lit(1.0))) == "#ff8c00"
    b = one(spark, tx.title_bounds(F.lit("TOP ACTIVATIONS<br>MAX = 1.250")))
    assert (b["bin_min"], b["bin_max"], b["bin_contains"]) == (-1.0, 1.25, -1.0)


def test_padding_and_suppression(spark):
    assert one(spark, v.pad(F.array(F.lit(1.0)), 3)) == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="longer"):
        one(spark, v.pad(F.array(F.lit(1.0), F.lit(2.0)), 1))
    assert one(spark, v.zero_suppressed(F.array(F.lit(0.5), F.lit(1e-9)))) == [0.5]


def test_interval_groups_hold_no_duplicates(spark):
    rng = np.random.default_rng(2)
    pos = [(p, i, 0) for p in range(20) for i in range(10)]
    acts = spark.createDataFrame([(0, p, i, 0, float(a)) for (p, i, _), a in zip(pos, rng.normal(size=200)) if a > 0], "feature_id int, prompt_idx long, pos int, token_id int, act double")
    tokens = spark.createDataFrame(pos, "prompt_idx long, pos int, token_id int")
    grouped = sequences.groups(acts, 200, 4)
    rows = sequences.members(acts, tokens, grouped, top=20, per_interval=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["group_ord"], []).append((r["prompt_idx"], r["pos"]))
    assert len(by[0]) == 20 and all(len(set(x)) == len(x) for x in by.values())
    assert all(len(by.get(g, [])) <= 5 for g in range(1, 5))


def test_ablation_against_numpy(spark):
    rng = np.random.default_rng(3)
    w_u, x, d = rng.normal(size=(12, 4)), rng.normal(size=4), rng.normal(size=4)
    active = spark.createDataFrame([(0, 0, 1, 0.7)], "feature_id int, prompt_idx long, pos int, act double")
    resid = spark.createDataFrame([(0, 1, x.tolist())], "prompt_idx long, pos int, x array<double>")
    dirs = spark.createDataFrame([(0, d.tolist())], "feature_id int, w_dec array<double>")
    unembed = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w_u)], "token_id int, w_u array<double>")
    nxt = spark.createDataFrame([(0, 1, 5)], "prompt_idx long, pos int, next_token int")

    def lsm(z):
        z = z / z.std(ddof=1) @ w_u.T
        return z - np.log(np.exp(z).sum())

    change = lsm(x) - lsm(x - 0.7 * d)
    got = prompt_scores.ablation(active, resid, dirs, unembed, nxt).first()
    assert got["loss"] == pytest.approx(-change[5]) and got["top5"] == np.argsort(-change)[:5].tolist() and got["bottom5"] == np.argsort(change)[:5].tolist()


def test_vector_set_and_norm_stats(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"vectors": [[1.0, 2.0], [3.0, 4.0]]}))
    rows = readers.vector_set(spark, f"file://{tmp_path}/v.json", 2).orderBy("feature_id").collect()
    assert [(r["name"], r["w_enc"]) for r in rows] == [("vector_0", [1.0, 2.0]), ("vector_1", [3.0, 4.0])]
    (tmp_path / "n.json").write_text(json.dumps({"3": {"inputs": {"mean": [0.5], "std": [2]}}}))
    assert readers.norm_stats(spark, f"file://{tmp_path}/n.json", 3) == ([0.5], [2.0])
    assert readers.norm_stats(spark, f"file://{tmp_path}/n.json", 4) is None


def test_bulk_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="model_name, creator_id"):
        sinks.ExportConfig()
    config = sinks.ExportConfig("demo-it", "me", "r", "R", "u", "set", 2, "hook_resid_post")
    assert (config.source, config.hook) == ("2-set", "blocks.2.hook_resid_post")
    sinks.write_heads(spark, config, "2026-01-01", f"file://{tmp_path}/x")
    assert spark.read.json(f"file://{tmp_path}/x/model").first()["instruct"] is True
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.write_bulk(rows, f"file://{tmp_path}/bulk")
    sinks.rewrite(spark, f"file://{tmp_path}/bulk", f"file://{tmp_path}/new", "a", "z")
    assert spark.read.json(f"file://{tmp_path}/new").first()["a"] == "z"
    page = sinks.html_page(spark.createDataFrame([(7, "</script>")], "feature_index int, t string"), "T")
    assert "</script>\"" not in page and ">7<" in page


def test_streaming_stats(spark, tmp_path):
    acts = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 0.5)], "feature_id int, act double")
    acts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(acts.schema).parquet(f"{tmp_path}/in")
    q = running_stats(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r["feature_id"]: (r["n_active"], r["act_max"]) for r in spark.table("running").collect()} == {0: (2, 2.0), 1: (1, 0.5)}
    events = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2026-01-01 00:50:00', 'a', 3.0D")
    assert windowed_values(events).first()["total"] == 5.0


def test_dashboard_batches_round_trip(spark, tmp_path):
    from actlake.operators.prompts import to_run
    from actlake.plans.queries import dashboard_features
    from actlake.sources.model_tables import ModelTables

    rows = dashboard_features(ModelTables(spark, "/root/testdata/sf0.001"))
    activations = F.transform("activations", lambda a: a.dropFields("rank"))
    batched = rows.withColumn("activations", activations).withColumn("batch_id", F.floor(F.col("feature_index") / 8).cast("int"))
    head = {"model_id": "demo", "layer": "3", "sae_set": "demo-set", "sae_id_suffix": ""}
    sinks.write_batches(batched, head, f"file://{tmp_path}/out")
    back = readers.written_batches(spark, f"file://{tmp_path}/out")
    found = {r["batch_id"]: r for r in back.collect()}
    assert sorted(found) == [0, 1] and [f["feature_index"] for f in found[1]["features"]] == list(range(8, 16))
    one = found[0]["features"][0]["activations"][0]
    assert len(one["tokens"]) == len(one["values"]) and one["bin_min"] == -1.0
    assert max(one["values"]) <= one["bin_max"] + 1e-4
    assert to_run(batched, back.select("batch_id"), 0, 1).count() == 0


def test_rename_in_place_puts_back_what_a_lost_run_left(spark, tmp_path):
    rows = spark.createDataFrame([(1, "old"), (2, "old")], "index int, modelId string")
    sinks.write_bulk(rows, f"file://{tmp_path}/bulk")
    (tmp_path / "bulk").rename(tmp_path / "bulk.old")  # as if a run had been stopped between its two moves
    sinks.rename_in_place(spark, f"file://{tmp_path}/bulk", "modelId", "new")
    assert {r["modelId"] for r in spark.read.json(f"file://{tmp_path}/bulk").collect()} == {"new"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bulk"]


def test_cache_is_keyed_by_files_and_settings(spark, tmp_path):
    from actlake.sources.cache import TableCache

    spark.range(3).write.parquet(f"file://{tmp_path}/in")
    built = []
    make = lambda: built.append(1) or spark.range(5)
    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert TableCache(spark, [f"file://{tmp_path}/in"], settings).load_or_build("t", make).count() == 5
    assert len(built) == 2
    spark.range(4).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    TableCache(spark, [f"file://{tmp_path}/in"], {"a": 1}).load_or_build("t", make)
    assert len(built) == 3


def test_hot_keys_are_spread_and_numbers_are_dense(spark, monkeypatch):
    from actlake.operators import spread

    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    many = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(200)], "i int, k string")
    one = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, v int")
    hot = spread.hot_keys(many.groupBy("k").count().withColumnRenamed("count", "n"), ["k"])
    assert hot.collect()[0]["_parts"] == 10
    for how, n in (("inner", 101), ("left", 200), ("left_semi", 101), ("left_anti", 99)):
        assert spread.spread_join(many, one, ["k"], hot, ["i"], how).count() == n
    parts = []

    def save(df):
        parts.append(f"{len(parts)}")
        df.write.mode("overwrite").saveAsTable(f"numbered_{parts[-1]}")
        return spark.table(f"numbered_{parts[-1]}")

    got = spread.numbered(many.repartition(5), ["i"], "no", save).collect()
    assert all(r["no"] == r["i"] for r in got)
    for p in parts:
        spark.sql(f"DROP TABLE numbered_{p}")


def test_attribution_guards(spark):
    from actlake.operators import attribution as dfa

    rng = np.random.default_rng(4)
    heads, kv, width, n, feats = 4, 2, 3, 5, 7
    w, v, a = rng.normal(size=(feats, heads * width)), rng.normal(size=(n, kv * width)), rng.random((n, heads))
    enc = spark.createDataFrame([(f, w[f].tolist()) for f in range(feats)], "feature_id int, w_enc array<double>")
    rows = spark.createDataFrame([(9, h, 4, s, float(a[s, h])) for h in range(heads) for s in range(n)], "prompt_idx long, head int, dest int, src int, w double")
    values = spark.createDataFrame([(9, i, v[i].tolist()) for i in range(n)], "prompt_idx long, pos int, v array<double>")
    targets = spark.createDataFrame([(f, 9, 4) for f in (2, 5)], "feature_id int, prompt_idx long, pos int")
    got = {r["feature_id"]: r["dfa"] for r in dfa.attribute(targets, dfa.by_source(rows), values, enc, heads, width, kv).collect()}
    for f in (2, 5):
        want = [sum(a[s, h] * (v[s, h // 2 * width : h // 2 * width + width] @ w[f, h * width : h * width + width]) for h in range(heads)) for s in range(n)]
        assert got[f] == pytest.approx(want)
    assert dfa.attribute(targets, dfa.by_source(rows), values, enc.limit(0), heads, width, kv).count() == 0
    with pytest.raises(ValueError, match="entries"):
        dfa.attribute(targets, dfa.by_source(rows), values, enc, heads, width + 1, kv)
    with pytest.raises(ValueError, match="multiple"):
        dfa.attribute(targets, dfa.by_source(rows), values, enc, heads, width, 3)
