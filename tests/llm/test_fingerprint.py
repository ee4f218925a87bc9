import hashlib
import re

import pytest
from pyspark.sql import functions as F

from actlake.llm import fingerprint


def words_of(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


def xxhash64(spark, terms):
    """Spark's own hash of strings, and of (long, seed) and arrays of longs through the functions below."""
    df = spark.createDataFrame([(t,) for t in sorted(terms)] or [("",)], "t string")
    return {r["t"]: r["h"] for r in df.select("t", F.xxhash64("t").alias("h")).collect()}


def brute(spark, rows, rare=fingerprint.RARE, common=fingerprint.COMMON):
    """The same by Python loops over (doc_id, text), but for the hash function, which is Spark's."""
    import xxhash

    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    n, df = len(ordered), {}
    for _, t in ordered:
        for w in words_of(t) - {""}:
            df[w] = df.get(w, 0) + 1
    band = {w for w, k in df.items() if max(2.0, rare * n) <= k <= max(common * n, 2.0)}
    above = {w for w, k in df.items() if k > max(common * n, 2.0)}
    texts = []
    for i, (d, t) in enumerate(ordered):
        cut = len(t) // 4
        texts.append((d, t, t[: len(t) - cut] + ordered[(i + 1) % n][1][:cut]))
    code = {w: h & ~7 for w, h in xxhash64(spark, {w for _, t, e in texts for w in words_of(t) | words_of(e)}).items()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def long_hash(values, seed=42):
        """Spark hashes longs one after another, each seeded with the hash before."""
        h = seed
        for v in values:
            h = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), h)
        return h

    def drawn(h, seed, bits):
        own = h & (2**64 - 1) if seed < 6 else long_hash([h])
        return (own >> (3 + 10 * (seed % 6))) & ((1 << bits) - 1) == 0

    def mark(text):
        own = words_of(text) - {""}
        chosen = own & band if len(own & band) >= fingerprint.FEW else own - above
        hashes = sorted(code[w] for w in chosen)
        if not hashes:
            return "=" + hashlib.sha256(text.lower().encode()).hexdigest()[:32]
        said = lambda s: f"{long_hash(s) & 0xFFFFFFFF:08X}" if s else "-"
        subsets = {}
        for seed in range(fingerprint.SEEDS):
            left = hashes
            for level, bits in enumerate(fingerprint.LEVEL_BITS):
                left = [h for h in left if drawn(h, seed, bits)]
                subsets[level, seed] = said(left)
        return ",".join([said(hashes), *(subsets[k] for k in sorted(subsets))])

    def near(a, b):
        if a == b:
            return 1.0
        if a[0] == "=" or b[0] == "=":
            return 0.0
        x, y, best = a.split(",")[1:], b.split(",")[1:], 0.0
        for i in range(0, len(x), fingerprint.SEEDS):
            pairs = [(p, q) for p, q in zip(x[i : i + fingerprint.SEEDS], y[i : i + fingerprint.SEEDS]) if (p, q) != ("-", "-")]
            if 2 * len(pairs) >= fingerprint.SEEDS:
                best = max(best, sum(p == q for p, q in pairs) / len(pairs))
        return best

    marks = [mark(t) for _, t, _ in texts]
    out = []
    for i, (d, t, e) in enumerate(texts):
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), marks[i], mark(e), near(marks[i], mark(e)), near(marks[i], marks[(i + 1) % n])))
    return sorted(out, key=repr)


def run(docs, **options):
    rows = fingerprint.compare(docs, **options).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    return sorted(map(tuple, rows), key=repr)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    rows = fingerprint.compare(odd_docs).collect()
    assert len(rows) == len(odd_rows) and fingerprint.compare(no_docs).count() == 0
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    same = {}
    for r in rows:
        same.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert same[1] == same[2] and len(same[6] | same[7]) == 1
    assert run(odd_docs) == brute(spark, [(d, t) for d, t, *_ in odd_rows])


@pytest.mark.parametrize("broadcast", [0, 10**9])
def test_whole_results_against_brute_force(spark, monkeypatch, broadcast):
    """With the lexicon broadcast and joined by a shuffle."""
    monkeypatch.setattr(fingerprint, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(fingerprint, "GATHERED", 128 if broadcast else 3)
    rows = [(i * 3 % 101, f"{'é😀x ' * (i % 9)}word{i} common term{i % 5} kind{i % 12} " * (i % 6) + f" own{i // 2}") for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"rare": 0.05, "common": 0.1}):
        assert run(docs, **options) == brute(spark, rows, **options)


def test_single_document(spark):
    docs = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    assert run(docs) == brute(spark, [(5, "only one text here")])


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"everywhere half{i % 2} tenth{i % 10} only{i}") for i in range(100)], "doc_id long, text string")
    code = {h & ~7: w for w, h in xxhash64(spark, {w for r in docs.collect() for w in words_of(r["text"])}).items()}
    found = {code[r["term"]]: r["above"] for r in fingerprint.lexicon(docs).collect()}
    assert found == {"everywhere": True, "half0": True, "half1": True} | {f"tenth{i}": False for i in range(10)}
    assert not any(not r["above"] for r in fingerprint.lexicon(docs, rare=0.11).collect())


def test_rare_languages_keep_terms(spark):
    """Terms too rare for the band stand in where a document has no others."""
    rows = [(i, " ".join(f"usual{j}" for j in range(i % 7, i % 7 + 20))) for i in range(400)] + [(1000, " ".join(f"seldom{j}" for j in range(60)))]
    got = {r["doc_id"]: r for r in fingerprint.compare(spark.createDataFrame(rows, "doc_id long, text string"), rare=0.01).collect()}
    assert not got[1000]["fingerprint"].startswith("=") and got[1000]["near_edited"] > 0


def test_likeness(spark):
    x = ",".join(["A"] * (1 + fingerprint.LEVELS * fingerprint.SEEDS))
    df = spark.createDataFrame([(x, x), (x, x.replace("A", "B")), ("=a", x), ("=a", "=a")], "a string, b string")
    assert [r[0] for r in df.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 1.0]
