"""Periodic runs against a brute-force search, on odd rows and at every way of refining."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from actlake.llm import registry, runs


def brute(w, min_length, min_exponent):
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        t = 0
        while t < n - q:
            if w[t] != w[t + q]:
                t += 1
                continue
            e = t
            while e < n - q and w[e] == w[e + q]:
                e += 1
            size, part = e - t + q, w[t : e + q]
            if size >= max(min_length, min_exponent * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((t, size, q))
            t = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, count=5):
    rnd = random.Random(seed)
    for _ in range(count):
        k, n = rnd.choice([1, 2, 3, 5, 40]), rnd.randrange(0, 100)
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            if n:
                a, p = rnd.randrange(n), rnd.randrange(1, 13)
                for i in range(a, min(n, a + rnd.randrange(70))):
                    w[i] = w[a + (i - a) % p]
        yield w


@pytest.mark.parametrize("few, scanned", [(0, 1), (0, 4), (48, 4), (10**9, 4), (10**9, 1)])
def test_equals_brute_force(monkeypatch, few, scanned):
    monkeypatch.setattr(runs, "FEW", few)
    monkeypatch.setattr(runs, "SCANNED", scanned)
    for seed in range(25):
        given = list(texts(seed))
        for least, exponent in ((24, 3), (4, 2), (1, 2), (6, 4)):
            got = [[tuple(r) for r in x.tolist()] for x in runs.runs_of(given, least, exponent)]
            assert got == [brute(w, least, exponent) for w in given], seed


def test_fibonacci_words_have_nested_runs():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in runs.runs_of([list(b)], 2, 2)[0].tolist()] == brute(list(b), 2, 2)


def test_one_word_repeated_and_a_long_period():
    many = runs.runs_of([["x"] * 5000, [str(i % 1700) for i in range(5200)]], 24, 3)
    assert many[0].tolist() == [[0, 5000, 1]] and many[1].tolist() == [[0, 5200, 1700]]


def expected(doc_id, text):
    """The contract of the query, word by word."""
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    found, gone = brute(w, 24, 3), set()
    for s, m, q in found:
        gone |= set(range(s + q, s + m))
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, sha(rows.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_digests_of_odd_rows(spark):
    rnd = random.Random(3)
    given = [(i, " ".join(map(str, w))) for i, w in enumerate(texts(11, 120))]
    given += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (None, "a " * 30), (203, "x y " * 40), (203, "x y " * 40), (204, "\x1c \x85 " * 20)]
    given += [(300 + i, "\n".join(rnd.choice("abc") for _ in range(200))) for i in range(40)]
    out = runs.digests(spark.createDataFrame(given, "doc_id long, text string").repartition(3))
    assert out.columns == COLUMNS
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == sorted(((i, *expected(i, t)) for i, t in given), key=lambda r: (r[0] is None, r[0] or 0))


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = registry.queries()["op11_periodic_runs"](spark, sf_dir)
    assert out.columns == COLUMNS and dict(out.dtypes)["exponent_milli"] == "bigint"
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = out.collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    short = [r for r in rows if len(docs[r.doc_id] or "") < 3000]
    assert [tuple(r)[1:] for r in short] == [expected(r.doc_id, docs[r.doc_id]) for r in short]


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([("b " * 30, 1, 2, 3)], "text string, `a.b` int, _row int, runs int")
    out = runs.periodic_runs(rows)
    assert out.columns == ["text", "a.b", "_row", "runs", "n_words", "collapsed"]
    assert out.select(F.col("`a.b`"), F.col("_row"), "runs", "collapsed").first()[:] == (1, 2, [(0, 30, 1)], "b")
    assert runs.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(rows, min_exponent=1)
