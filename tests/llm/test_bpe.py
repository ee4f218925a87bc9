import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from actlake.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_equal_tiktoken(oracle):
    import numpy as np
    import regex

    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdeAB .,!\n\t\x1c\x85 éßя漢字😀'stv0123²", k=rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 2000, "漢字" * 1500, " " * 2000, "!?" * 1000, "abcab" * 1000]
    enc = bpe.RankQueueEncoder(bpe.load_ranks(PATH))
    got = enc.encode_chunk(texts, regex.compile(P.PATTERN).findall)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [oracle.encode_ordinary(t) for t in texts]


def test_wide_and_narrow_buckets_agree(monkeypatch):
    words = ["".join(random.Random(i).choices("etaoin", k=9)).encode() for i in range(400)] + [b"aaaaaaaa", b"abababab"]
    enc = bpe.RankQueueEncoder(bpe.load_ranks(PATH))
    monkeypatch.setattr(bpe, "WIDE", 2)
    wide = enc.merge(words)
    monkeypatch.setattr(bpe, "WIDE", 10**9)
    assert wide == enc.merge(words)


def test_round_trip_of_odd_documents(spark, odd_docs, odd_rows, oracle):
    import hashlib

    rows = bpe.digests(odd_docs, PATH, P.PATTERN).collect()
    assert len(rows) == len(odd_rows)
    want = sorted((hashlib.sha256((t or "").encode()).hexdigest(), len(oracle.encode_ordinary(t or ""))) for _, t, _, _ in odd_rows)
    assert sorted((r["decoded_sha256"], r["n_tokens"]) for r in rows) == want
    both = bpe.decode(bpe.encode(odd_docs, PATH, P.PATTERN), PATH)
    assert both.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).isEmpty()


def test_clashing_names(odd_docs):
    out = bpe.round_trip(odd_docs.withColumn("_coded", F.lit("mine")), PATH, P.PATTERN)
    assert {r["_coded"] for r in out.collect()} == {"mine"} and out.columns == [*odd_docs.columns, "_coded", "decoded"]


def test_empty_table(no_docs):
    assert bpe.digests(no_docs, PATH, P.PATTERN).count() == 0
