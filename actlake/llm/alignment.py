"""Alignment of two tokenizers over the same bytes, by packed bitsets.

Each tokenizer's token ends are bits over the bytes of a chunk of texts. The AND of both bitsets holds the shared cuts;
population counts of the words before a cut, and of the cut's own word below it (rank), give the token of either side
that ends there, so byte cuts become token ranges. Tokens between two cuts are a group, and the two tokens that end at a
cut are linked.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from actlake.llm.common import Workspace, bounded_batches, hot_keys, packed, spread_join, unpacked

#: Characters of text that are aligned together.
CHUNK_CHARS = 2_000_000
#: Up to so many distinct id pairs are broadcast with their counts; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
LINKS = "array<struct<a:int,b:int,n:bigint>>"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters are themselves, the other bytes are the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text.

    Where ids follow the order of merges and the pre-tokens are those of the byte-level pattern, tiktoken encodes alike and
    faster; else the tokenizers library does.
    """

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, model = byte_of_symbol(), spec["model"]
        special = {t["id"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max(model["vocab"].values(), default=-1))
        for token, i in model["vocab"].items():
            self.tokens[i] = token.encode() if i in special else bytes(symbols[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ordered = [model["vocab"]["".join(p)] for p in pairs]
        pre = spec["pre_tokenizer"]
        alike = ordered == sorted(ordered) and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")
        if alike:
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.tokens) if i not in special}
            self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
        self.encode = model.encode


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_bytes, self.b_bytes = (np.array([len(t) for t in x.tokens], dtype=np.int64) for x in (self.a, self.b))
        na, nb = len(self.a.tokens), len(self.b.tokens)
        #: Written forms of ids: within a side, and at the end of group's side a or b.
        self.written = [f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)] + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)]

    def align(self, texts: list[str | None]) -> pa.Table:
        """n_a, n_b, n_groups, groups and links of each text."""
        out = {name: np.zeros(len(texts), dtype=np.int64) for name in ("n_a", "n_b", "n_groups")}
        groups, link_counts = [""] * len(texts), np.zeros(len(texts), dtype=np.int64)
        ids_a, ids_b, docs, sizes, whole_a, whole_b = array("i"), array("i"), [], [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            raw, a, b = b" " + text.encode(), self.a.encode(" " + text), self.b.encode(text)
            if b"".join(map(self.a.tokens.__getitem__, a)) != raw or b"".join(map(self.b.tokens.__getitem__, b)) != raw:
                continue
            ids_a.extend(a)
            ids_b.extend(b)
            docs.append(k)
            sizes.append(len(raw))
            whole_a.append(len(a))
            whole_b.append(len(b))
        links = (np.zeros(0, dtype=np.int32),) * 2 + (np.zeros(0, dtype=np.int64),)
        if docs:
            a, b = np.frombuffer(ids_a, dtype=np.int32), np.frombuffer(ids_b, dtype=np.int32)
            cuts, at_a, at_b = shared_cuts(self.a_bytes[a], self.b_bytes[b], sum(sizes))
            own = np.searchsorted(np.cumsum(sizes), cuts)  # the text whose bytes hold the cut
            docs = np.array(docs)
            out["n_a"][docs], out["n_b"][docs] = whole_a, whole_b
            out["n_groups"][docs] = np.bincount(own, minlength=len(docs))
            self._write(groups, docs, a, b, at_a, at_b, np.cumsum(whole_a), np.cumsum(whole_b))
            # Distinct linked pairs of a text, with their numbers.
            pair = a[at_a].astype(np.int64) * len(self.b.tokens) + b[at_b]
            kinds, n = np.unique(own * (len(self.a.tokens) * len(self.b.tokens)) + pair, return_counts=True)
            text_of, pair = np.divmod(kinds, len(self.a.tokens) * len(self.b.tokens))
            links = ((pair // len(self.b.tokens)).astype(np.int32), (pair % len(self.b.tokens)).astype(np.int32), n.astype(np.int64))
            link_counts[docs] = np.bincount(text_of, minlength=len(docs))
        offsets = pa.array(np.concatenate(([0], np.cumsum(link_counts))).astype(np.int32))
        linked = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in links], ["a", "b", "n"]))
        return pa.table({**{name: pa.array(x) for name, x in out.items()}, "groups": pa.array(groups, pa.string()), "links": linked})

    def _write(self, groups: list[str], docs: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        """`a1,a2|b1;a3|b2,b3` of each text: tokens of both sides in the order in which they are written."""
        na, nb = len(self.a.tokens), len(self.b.tokens)
        code_a, code_b = a.astype(np.int64), b.astype(np.int64) + 2 * na
        code_a[at_a] += na
        code_b[at_b] += nb
        before_a = np.repeat(np.append(-1, at_b[:-1]) + 1, np.diff(np.append(-1, at_a)))  # tokens of b in earlier groups
        before_b = np.repeat(at_a + 1, np.diff(np.append(-1, at_b)))  # tokens of a up to the own group
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + before_a] = code_a
        codes[np.arange(len(b)) + before_b] = code_b
        start, form = 0, self.written.__getitem__
        for k, end in zip(docs.tolist(), (ends_a + ends_b).tolist()):
            groups[k] = "".join(map(form, codes[start:end].tolist()))[:-1]
            start = end


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Words of 64 bits; bit i is set where a token ends after byte i."""
    bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits below each position."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & below)


def shared_cuts(a_bytes: np.ndarray, b_bytes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions (of the last byte before it) of each shared cut, and the tokens of a and b that end there."""
    a, b = bitset(np.cumsum(a_bytes), size), bitset(np.cumsum(b_bytes), size)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    return cuts + 1, rank(a, cuts), rank(b, cuts)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker and pair of files."""
    return Aligner(a_path, b_path)


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Adds the alignment of a byte-level BPE (a) and a sentencepiece model (b) over each whole text, with a space before it.

    n_a, n_b: tokens. n_groups: stretches between byte offsets where tokens of both end. groups: `a1,a2|b1;a3|b2,b3`,
    ids in order. links: (a, b, n), distinct id pairs of tokens that end together, and how often they do in the text.
    A null or empty text, or one that either tokenizer's tokens don't spell byte by byte, has none: zeros, an empty string
    and an empty array. Very long texts are aligned in memory in proportion to their length; repeated rows have results each,
    an empty table has none. Other columns pass through, whatever they are called; one named like a new one is replaced.
    """
    bounded_batches(df.sparkSession)
    given = packed(df, _text=F.col(text_col).cast("string"))
    new = StructType([*(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups")), StructField("groups", StringType()), StructField("links", _links_type(df))])
    schema = StructType([given.schema["_row"], *new])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, chars = batch.column("_text").to_pylist(), 0, 0
            for k, t in enumerate(texts, 1):
                chars += len(t or "")
                if chars >= CHUNK_CHARS or k == len(texts):
                    made = aligner(a_path, b_path).align(texts[start:k]).combine_chunks().to_batches()
                    rows = batch.column("_row").slice(start, k - start)
                    for part in made:
                        yield pa.RecordBatch.from_arrays([rows, *part.columns], ["_row", *part.schema.names])
                    start, chars = k, 0

    out = given.mapInArrow(aligned, schema)
    return unpacked(out, df.columns, **{c: F.col(c) for c in new.names})


def _links_type(df: DataFrame):
    return df.sparkSession.range(0).select(F.lit(None).cast(LINKS).alias("x")).schema["x"].dataType


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (links of all texts that hold it) and best (whether no other pair of its b has more), from a, b, n.

    Sums are taken in parts before the shuffle, so a pair that all texts hold is a row a task. The largest counts, one row an
    id of b, number at most b's vocabulary.
    """
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return counts.join(F.broadcast(most), "b").select(pair_key().alias("pair"), "count", (F.col("count") == F.col("_most")).alias("best"))


def pair_key():
    return F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of documents.

    Alignments are written once; links of all texts are counted, and each text's are joined with the counts.
    """
    ws = Workspace(docs.sparkSession, "alignment")
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    made = align(docs.select("doc_id", "text"), a_path, b_path)
    made = ws.save(made.select("doc_id", "n_a", "n_b", "n_groups", sha.alias("groups_sha256"), "links", F.monotonically_increasing_id().alias("_at")))
    exploded = made.select("_at", F.inline("links"))
    counts = ws.save(pair_counts(exploded))
    links = exploded.select("_at", pair_key().alias("pair"), "n")
    if counts.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = spread_join(links, counts, ["pair"], hot_keys(ws.save(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))), ["pair"]), ["_at"])
    sums = met.groupBy("_at").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return made.drop("links").join(sums, "_at", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
