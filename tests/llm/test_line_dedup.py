import hashlib

from pyspark.sql import functions as F

from actlake.llm import line_dedup


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    owner = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line).decode()) >= 10:
                owner[key(line)] = min(d, owner.get(key(line), d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(docs, **options):
    return sorted(map(tuple, line_dedup.dedup_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    assert run(odd_docs) == brute(odd_rows)
    assert run(no_docs) == []


def test_many_batches_and_levels(spark):
    rows = [(i, f"a line that everyone has\nline number {i % 7} of seven\nmy own line {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 5, 9):
        assert run(docs, batches=batches) == brute(rows)


def test_query_digest(spark, odd_docs):
    row = line_dedup.dedup_lines(odd_docs).where("doc_id = 5").select(F.sha2(F.col("kept").cast("binary"), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"\nx").hexdigest()


def test_hot_lines_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 10)
    monkeypatch.setattr(line_dedup, "HOT", 10)
    rows = [(i, f"a line that everyone has\nline number {i % 7} of seven\nmy own line {i}\nA LINE that everyone has ") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_doc", F.lit("mine")).withColumn("_text", F.lit(1)).withColumn("kept", F.lit("old"))
    assert run(docs) == brute(rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "_doc", "_text", "kept", "n_lines", "n_dropped"] and {r["_doc"] for r in out.collect()} == {"mine"}


def test_store_outlives_a_call_and_merges_without_shuffles(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    owner, own = {}, line_dedup.LineStore(spark, folder)
    for b in range(5):
        rows = [(h, -h, 100 * b + h % 3) for h in range(b * 7, b * 7 + 20)] * 2
        for h, _, d in rows:
            owner[h] = min(owner.get(h, d), d)
        own.add(spark.createDataFrame(rows, "_h1 long, _h2 long, _doc long"))
        own = line_dedup.LineStore(spark, folder)
    assert len(own.runs()) == 2
    got = sorted(tuple(r) for run in own.runs() for r in run.collect())
    assert got == sorted((h, -h, d) for h, d in owner.items())
    one, two = own.runs()
    plan = one.join(two.hint("merge"), line_dedup.KEY, "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
