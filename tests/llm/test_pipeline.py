"""Each stage of the pipeline on odd rows and against a brute-force version, and the stages one after another."""

import importlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(pipeline.STAGES)


def load(name):
    """A test module beside this one, for its brute-force version."""
    return importlib.import_module(name)


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    """odd_docs and labels of some of them as tables, with a good share of label 1."""
    path = f"file://{tmp_path_factory.mktemp('pipeline')}"
    odd_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in (1, 2, 4, 5, 9, 10)] + [(13, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return Counter(map(repr, df.select("doc_id", "text", "lang", "source").collect()))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, folder, name):
    out = STAGES[name](spark, odd_docs, folder)
    if name != "byte-level BPE":
        assert out.columns == odd_docs.columns
        kept = out.where("text IS NOT NULL").collect()
        assert all(r["key"] == "extra key" and r["size"] == "extra size" and r["n_chars"] == len(r["text"]) for r in kept)
    assert out.columns == STAGES[name](spark, no_docs, folder).columns
    assert STAGES[name](spark, no_docs, folder).count() == 0


def test_quality_stage(spark, odd_docs, folder):
    from actlake.llm import quality

    model = quality.fit(odd_docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = [r["text"] for r in odd_docs.collect()]
    good = {t for t, p in zip(texts, model.score(quality.statistics(texts))) if p >= 0.5}
    want = Counter(repr(r) for r in odd_docs.select("doc_id", "text", "lang", "source").collect() if r["text"] in good)
    assert rows(STAGES["quality classifier"](spark, odd_docs, folder)) == want


def test_line_stage(spark, odd_docs, odd_rows, folder):
    kept = {}
    for d, n, gone, text in load("test_line_dedup").brute(odd_rows):
        kept.setdefault((d, n), []).append((gone, text))
    got = STAGES["line dedup"](spark, odd_docs, folder).collect()
    left = Counter((r["doc_id"], r["text"]) for r in got)
    want = Counter()
    for d, t, *_ in odd_rows:
        gone, text = next(x for x in kept[d, len((t or "").split("\n"))] if len(x[1]) <= len(t or "") and (x[0] or x[1] == (t or "")))
        if not gone or text.strip(" \t\n\x0b\x0c\r"):
            want[d, None if t is None else text] += 1
    assert left == want and (3, "") not in left


def test_near_duplicate_stage(spark, odd_docs, odd_rows, folder):
    component, _ = load("test_neardup").brute(odd_rows, 5)
    want = Counter(d for d, *_ in odd_rows if d is None or component[d] == d)
    assert Counter(r["doc_id"] for r in STAGES["MinHash near-dedup"](spark, odd_docs, folder).collect()) == want


def test_mixing_stage(spark, odd_docs, odd_rows, folder):
    from actlake.llm import mixing

    words = lambda t: len((t or "").encode().split())
    copies = Counter()
    for r in mixing.mix(odd_docs).collect():
        if r["taken"]:
            copies[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"]
    got = STAGES["mixing sources"](spark, odd_docs, folder).collect()
    assert Counter((r["doc_id"], r["source"], words(r["text"])) for r in got) == copies and all(words(r["text"]) for r in got)


def test_token_stage(spark, odd_docs, odd_rows, folder):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    from actlake.llm import bpe

    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((d, tuple(oracle.encode_ordinary(t or ""))) for d, t, *_ in odd_rows)
    got = STAGES["byte-level BPE"](spark, odd_docs, folder).collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)


def test_stages_one_after_another(spark, tmp_path_factory):
    """A corpus with junk, shared lines, near copies and two sources through run(), against the same by loops up to the mix."""
    from actlake.llm import quality

    own, brute_lines, brute_near = load("test_quality").corpus(260), load("test_line_dedup").brute, load("test_neardup").brute
    docs = []
    for i, t, _ in own:
        body = t if i % 5 else own[(i // 10) * 10 + 1][1] + f" ending{i}"
        docs.append((i, body + ("\nThis line stands in many documents" if i % 3 else "") if i % 17 else t, "en", f"s{i % 2}"))
    path = f"file://{tmp_path_factory.mktemp('run')}"
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, y) for i, _, y in own], "doc_id long, quality int")
    labels.write.parquet(f"{path}/labels.parquet")
    scores = quality.fit(df, labels).score(quality.statistics([t for _, t, *_ in docs]))
    good = [r for r, p in zip(docs, scores) if p >= 0.5]
    assert 0 < len(good) < len(docs)
    lined = [(d, t) for d, _, gone, t in brute_lines(good) if not gone or t.strip()]
    component, _ = brute_near(lined, 5)
    left = {d: t for d, t in lined if component[d] == d}
    assert len(left) < len(lined)
    out = pipeline.run(spark, path).collect()
    taken = Counter(r["doc_id"] for r in out)
    assert set(taken) <= set(left) and max(taken.values()) <= 2
    size = {d: len(t.split()) for d, t in left.items()}
    totals = {s: sum(n for d, n in size.items() if d % 2 == s) for s in (0, 1)}
    want = load("test_mixing").targets_brute({f"s{s}": n for s, n in totals.items()})
    for s in (0, 1):
        assert abs(sum(size[d] * n for d, n in taken.items() if d % 2 == s) - want[f"s{s}"]) <= max(size.values())
    assert pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGES)[:4])
def test_stages_take_dotted_names(spark, odd_docs, folder, name):
    out = STAGES[name](spark, odd_docs.withColumn("a.b", F.lit("dot")).withColumn("_row", F.lit("row")), folder)
    assert out.columns == [*odd_docs.columns, "a.b", "_row"]
    assert {tuple(r) for r in out.select("`a.b`", "_row").collect()} <= {("dot", "row")}


def python_nodes(df):
    """Most nodes that run Python in one stage of the plan before it runs."""
    import re

    most = own = 0
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):  # these plans have no branch inside a stage with Python
        own = 0 if "Exchange" in line else own + bool(re.search(r"EvalPython|MapIn(Pandas|Arrow)|InPandas", line))
        most = max(most, own)
    return most


@pytest.mark.parametrize("name", ["quality classifier", "line dedup", "mixing sources", "byte-level BPE"])
def test_a_task_needs_one_python_worker(spark, odd_docs, folder, name):
    assert python_nodes(STAGES[name](spark, odd_docs, folder)) == 1


def test_a_task_that_learns_quality_needs_one_python_worker(spark, odd_docs, folder):
    from actlake.llm import quality

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert python_nodes(quality._moments(odd_docs, labels, "doc_id", "text", "quality")) == 1


def test_small_tables_need_no_python_worker(spark, odd_docs, folder, monkeypatch):
    """Common lines and hubs come to the driver and go out again without rows made by Python."""
    from actlake.llm import common, line_dedup

    monkeypatch.setattr(line_dedup, "HOT_ROWS", 1)
    monkeypatch.setattr(line_dedup, "HOT", 1_000)
    out = line_dedup.dedup_lines(odd_docs)
    assert "Scan ExistingRDD[_h1" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("actlake.operators.spread.HOT_ROWS", 1)
    hubs = common.hot_keys(spark.createDataFrame([("a", 3), (None, 9), ("b", 1)], "key string, n long"), ["key"])
    assert sorted(map(tuple, hubs.collect()), key=repr) == [("a", 3), (None, 9)]
    assert hubs.dtypes == [("key", "string"), ("_parts", "int")] and "ExistingRDD" not in hubs._jdf.queryExecution().executedPlan().toString()
