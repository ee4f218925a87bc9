import random

import numpy as np

from actlake.llm import quality
from actlake.llm.common import held_out


def corpus(n=600):
    rnd, rows = random.Random(0), []
    for i in range(n):
        words = ["".join(rnd.choices("etaoinshr", k=rnd.randint(2, 8))) for _ in range(rnd.randint(20, 80))]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 8 else "|".join(w + "$$$" for w in words)
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.drop("quality"), df.select("doc_id", "quality"))
    out = quality.score(df, model).where(held_out(df["doc_id"])).collect()
    assert len(out) > 100 and np.mean([(r["score"] >= 0.5) == r["quality"] for r in out]) > 0.98


def test_scores_are_the_gaussians(spark):
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {k: rng.normal(size=(400, d)) * (1 + k) + k for k in (0, 1)}
    model = quality.Quadratic({k: (len(m), m.sum(axis=0), m.T @ m) for k, m in x.items()})
    cov, mean = {}, {k: m.mean(axis=0) for k, m in x.items()}
    within = {k: np.cov(m.T, bias=True) for k, m in x.items()}
    pooled = (within[0] + within[1]) / 2
    s = np.sqrt(np.diag(pooled))
    for k in x:
        c = ((1 - quality.POOLED) * within[k] + quality.POOLED * pooled) / np.outer(s, s)
        cov[k] = (1 - quality.IDENTITY) * c + quality.IDENTITY * np.trace(c) / d * np.eye(d) + 1e-9 * np.eye(d)
    q = rng.normal(size=(20, d))
    log = {k: -0.5 * np.linalg.slogdet(cov[k])[1] - 0.5 * np.einsum("ij,jk,ik->i", q / s - mean[k] / s, np.linalg.inv(cov[k]), q / s - mean[k] / s) for k in x}
    assert np.allclose(model.score(q), 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (9, None), (None, 1)], "doc_id long, quality int")
    out = quality.score(odd_docs, quality.fit(odd_docs, labels)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    none = quality.fit(no_docs, labels)
    assert {r["score"] for r in quality.score(odd_docs, none).collect()} == {0.5} and quality.score(no_docs, none).count() == 0


def plain(text):
    """The statistics by loops over the characters, words and lines of one text."""
    import math

    raw = (text or "").encode()
    chars = sum(1 for b in raw if not 0x80 <= b < 0xC0)
    count = lambda own: sum(b in own for b in raw)
    wide = sum(b >= 0xC0 for b in raw)
    lower, upper, digit = count(b"abcdefghijklmnopqrstuvwxyz"), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789")
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    letters = lower + upper + wide
    rate = lambda x: math.sqrt(x / max(chars, 1))
    return [
        math.log1p(chars), math.log1p(n), math.log1p((chars - count(b" \t\r\x0b\x0c\n")) / max(n, 1)), math.log((letters + 0.5) / (max(chars - letters, 0) + 0.5)), rate(upper), rate(digit),
        rate(count(b".,;:?'\"()-")), rate(count(b"!")), rate(count(b"|")), rate(count(b"#$%&*@~^")), rate(count(b"+=<>/\\_{}[]`")), math.log1p(len(lines)), math.log1p(chars / len(lines)),
        math.log1p(len(set(words))) / math.log1p(max(n, 1)), len(set(lines)) / len(lines), math.sqrt(sum(w.isupper() for w in words) / max(n, 1)), math.sqrt(sum(w[-1:] in b"#$%&*@!~^|" for w in words) / max(n, 1)), rate(wide),
    ]


def test_statistics_against_loops(odd_rows):
    texts = [t for _, t, *_ in odd_rows] + ["A|B!! $x$ {a} 12 -é- ß\r\n\n\tUP up", "漢字 仮名|#", "!" * 50]
    assert np.allclose(quality.statistics(texts), [plain(t) for t in texts])


def test_moments_against_brute_force(spark):
    """What Spark adds up is what a loop over the rows that may be learnt from adds up, repeated rows included."""
    import zlib

    rows = corpus(120) + corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(7)
    labels = df.select("doc_id", "quality").distinct().unionByName(spark.createDataFrame([(5, 7), (None, 1)], "doc_id long, quality int"))
    model = quality.fit(df.drop("quality"), labels)
    own = {0: [], 1: []}
    for i, text, y in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            own[y].append(plain(text))
    want = quality.Quadratic({k: (len(m), np.sum(m, axis=0), np.array(m).T @ np.array(m)) for k, m in own.items()})
    q = quality.statistics([t for _, t, _ in rows])
    assert np.allclose(model.score(q), want.score(q))
