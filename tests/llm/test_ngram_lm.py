"""The n-gram model against one of plain dictionaries, its blocks and shards, and held-out text."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.llm import ngram_lm, registry

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def tokens(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*raw.split(), None]


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.words = order, Counter(w for t in texts for w in tokens(t))
        self.counts = {order: Counter()}
        for t in texts:
            w = ["<s>"] * (order - 1) + tokens(t)
            self.counts[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.under = {k: defaultdict(list) for k in self.counts}
        for k, grams in self.counts.items():
            for g, n in grams.items():
                self.under[k][g[:-1]].append(n)
        self.d = {k: ngram_lm.discounts(*(sum(n == c for n in grams.values()) for c in (1, 2, 3, 4))) for k, grams in self.counts.items()}

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        k = len(gram)
        below, found = self.p(gram[1:]), self.under[k].get(gram[:-1])
        if not found:
            return below
        cut = lambda n: self.d[k][min(n, 3) - 1] if n else 0
        n = self.counts[k].get(gram, 0)
        return (n - cut(n) + sum(map(cut, found)) * below) / sum(found)

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + tokens(text)
        total, size = sum(self.words.values()), len(self.words)
        own = tokens(text)
        base = math.fsum(math.log10((self.words[t] + 1) / (total + size + 1)) for t in own)
        whole = math.fsum(math.log10(self.p(tuple(w[i : i + self.order]))) for i in range(len(own)))
        return len(own), sum(self.words[t] > 0 for t in own), base, whole


def prose(seed, n=80):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "of", "é", "x" * 70, "X" * 70]
    return [" ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rnd.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [40, 1_000_000])
def test_equals_dictionaries(spark, monkeypatch, order, block):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(ngram_lm, "BLOCK_GRAMS", 50 if block == 40 else 10**6)
    train = [*prose(1), *prose(2, 20) * 2, None, "", " \n", "\x85 odd \x1c"]
    other = [*prose(7, 30), None, "", "never seen words", "the " * 200]
    model = ngram_lm.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), order)
    plain = Plain(train, order)
    assert (model.train_tokens, model.vocabulary) == (sum(plain.words.values()), len(plain.words))
    scorer = ngram_lm.Scorer(model)
    got = scorer.score(ngram_lm.WordHasher(), other + train)
    want = np.array([plain.score(t) for t in other + train])
    assert (got[["n_tokens", "n_known"]].to_numpy() == want[:, :2]).all()
    np.testing.assert_allclose(got[["base_score", "score"]].to_numpy(), want[:, 2:], rtol=1e-10, atol=1e-10)


def test_probabilities_sum_to_one(spark):
    train = prose(3, 30)
    model, plain = ngram_lm.fit(spark.createDataFrame([(t,) for t in train], "text string"), 3), Plain(train, 3)
    for context in (("<s>", "<s>"), ("<s>", b"the"), (b"w0", b"w1"), (b"no", b"such")):
        assert sum(plain.p((*context, w)) for w in [*plain.words, "unknown"]) == pytest.approx(1)
    assert model.grams.keys() == {1, 2, 3}


def test_hashes_tell_words_apart(monkeypatch):
    texts = [None, "", "a B a", "A b", "x" * 50, "X" * 50 + " x", "é É", "ab", "ba", "a\x00", "a", " ".join(map(str, range(5000)))]
    for block in (1, 9, 1_000_000):
        monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", block)
        got = defaultdict(list)
        for hashes, own in ngram_lm.WordHasher().texts(texts):
            for a, b in zip(hashes.tolist(), own.tolist()):
                got[b].append(a)
        pairs = {(w, h) for k, t in enumerate(texts) for w, h in zip(tokens(t), got[k], strict=True)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_packing():
    for x in ([], [0], [5, 3, 300, 2**40], [2**64 - 1, 0]):
        assert ngram_lm.unpack(ngram_lm.pack(np.array(x, dtype=np.uint64))).tolist() == x


def test_digests_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(prose(5, 60))] + [(100, None), (101, ""), (None, "the of the"), (102, "twice"), (102, "twice"), (103, "the " * 5000)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    out = ngram_lm.perplexities(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2)
    assert out.columns == COLUMNS
    plain = Plain([t for i, t in rows if not held(i)], 2)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in out.collect()), key=key)
    for r, (i, t) in zip(got, sorted(rows, key=key), strict=True):
        n, known, base, score = plain.score(t)
        assert r[:5] == (i, held(i), n, known, sum(plain.words.values())) and r[5:] == pytest.approx((base, score, 10 ** (-score / n)))


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.perplexities(none, 2).collect() == []
    model = ngram_lm.fit(none, 3)
    df = spark.createDataFrame([("a b", 1, 2, 3)], "text string, `a.b` int, _row int, score int")
    out = ngram_lm.score(df, model)
    assert out.columns == ["text", "a.b", "_row", "score", "n_tokens", "n_known", "base_score", "perplexity"]
    assert out.select("`a.b`", "_row", "n_tokens", "n_known", "base_score", "score").first()[:] == (1, 2, 3, 0, 0.0, 0.0)


def test_registered_query_predicts_held_out_text_better(spark):
    out = registry.queries()["op13_ngram_lm"](spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert out[2] > 10 and out[0] > 0.98 * out[1]  # logarithms: less negative is better
