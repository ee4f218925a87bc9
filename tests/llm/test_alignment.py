"""Alignment of two tokenizers against the libraries' own tokens and plain loops over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from actlake.llm import alignment, registry  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["hello world", "a  b\n\n<s> ▁x é <0x41>", "<|endoftext|> is plain text", "\U0001f600\U0001f600 漢字\r\ntab\there", " leading and trailing ", "x", "aaaa" * 300, "don't they've 1234567890 !!! ???", "\x00\x01 control", "antidisestablishmentarianism " * 40]


@pytest.fixture(scope="module")
def tools():
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def slow(tools, text):
    """Token ids of both, and groups as lists, from end offsets one by one."""
    t, sp = tools
    if not text:
        return [], [], []
    symbols = alignment.byte_of_symbol()
    a, b, raw = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
    a_bytes = [bytes(symbols[c] for c in t.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], [], []
    ends = lambda parts: list(np.cumsum([len(p) for p in parts]))
    ea, eb = ends(a_bytes), ends(b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        x, y = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups


def expected(tools, rows):
    made = [(i, *slow(tools, t)) for i, t in rows]
    pairs = Counter((g[0][-1], g[1][-1]) for *_, groups in made for g in groups)
    most = defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, groups in made:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_odd_rows(spark, tools, monkeypatch):
    rows = [*enumerate(TEXTS), (50, None), (51, ""), (None, "no id"), (52, "twice"), (52, "twice"), (53, "\U0001f468‍\U0001f469‍\U0001f467 é ＡＢ  　.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = alignment.digests(df, A, B)
    assert out.columns == COLUMNS and {t for c, t in out.dtypes if c.startswith(("n_", "count"))} == {"bigint"}
    want = ordered(expected(tools, rows))
    assert ordered(out.collect()) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 5)
    assert ordered(alignment.digests(df, A, B).collect()) == want


def test_registered_query(spark, tools):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = registry.queries()["op12_token_alignment"](spark, sf_dir)
    assert out.columns == COLUMNS
    assert ordered(out.collect()) == ordered(expected(tools, docs))


def test_tiktoken_and_tokenizers_agree(tools):
    fast = alignment.ByteLevel(A)
    assert all(list(fast.encode(t)) == tools[0].encode(t, add_special_tokens=False).ids for t in TEXTS)


def test_rank_and_cuts():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 300)
    size = max(a.sum(), b.sum())
    a, b = np.append(a, size + 1 - a.sum()), np.append(b, size + 1 - b.sum())
    ea, eb = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    want = sorted(set(ea) & set(eb))
    cuts, at_a, at_b = alignment.shared_cuts(a, b, int(size) + 1)
    assert cuts.tolist() == want and at_a.tolist() == [ea.index(c) for c in want] and at_b.tolist() == [eb.index(c) for c in want]


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("hello you", 1, 2, 3)], "text string, `a.b` int, _row int, links int")
    out = alignment.align(df, A, B)
    assert out.columns == ["text", "a.b", "_row", "links", "n_a", "n_b", "n_groups", "groups"]
    row = out.first()
    assert row["a.b"] == 1 and row["_row"] == 2 and len(row["links"]) == row["n_groups"]
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
