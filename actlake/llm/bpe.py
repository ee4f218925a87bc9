"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

One queue serves all pre-tokens of a chunk of documents at once. Adjacent symbols are linked lists over one
array of positions; each merge rank has a bucket of the positions whose pair has that rank; a three-level bitmap
over the ranks finds the lowest bucket that is not empty (find-first-set on each level). An entry whose pair has
changed since it was pushed is stale and is skipped. A bucket with many positions is merged as arrays, one merge for
each pre-token at a time, so that the order within a pre-token is kept. Lists end at pre-token borders, so pre-tokens never merge
with each other. Work is proportional to the number of pairs ever formed, also for one very long pre-token.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import bounded_batches, packed, unpacked

#: Characters of text whose new pre-tokens share one queue, and entries kept in a worker's memos.
CHUNK_CHARS, MEMO_ENTRIES, MEMO_KEY_CHARS, PAIR_ENTRIES = 4_000_000, 250_000, 256, 100_000
#: Buckets of at least so many positions are merged as arrays.
WIDE = 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueueEncoder:
    """Encodes pre-tokens by merge ranks. ids are ranks, as in tiktoken."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_pair = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int32)
        self.pairs: dict[int, dict[int, int]] = {}
        self.known = 0
        self.number: defaultdict[str, int] = defaultdict()
        self.packed: list[bytes] = []

    def pair_ranks(self, left: list[int], right: list[int]) -> list[int]:
        """Rank of each pair's merge, or -1."""
        out, rows, tokens, ranks = [], self.pairs, self.tokens, self.ranks
        for a, b in zip(left, right):
            row = rows.get(a)
            if row is None:
                row = rows[a] = {}
            new = row.get(b)
            if new is None:
                new = row[b] = ranks.get(tokens[a] + tokens[b], -1)
                self.known += 1
            out.append(new)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed little-endian uint32 ids of each word; words aren't empty."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
        lengths = np.array([len(w) for w in words])
        n, ends = len(raw), np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        nxt, prv, rank = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - lengths] = -1
        rank[:-1] = self.byte_pair[raw[:-1] * 256 + raw[1:]]
        rank[ends - 1] = -1
        ids, alive = self.byte_id[raw], np.ones(n, dtype=bool)

        buckets: dict[int, list[int]] = {}
        leaf, middle, top = [0] * (self.size // 64 + 1), [0] * (self.size // 4096 + 1), 0

        def push(at: np.ndarray) -> None:
            """Puts positions into the buckets of their ranks, and sets the bits of buckets that were empty."""
            nonlocal top
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            at, r = at.tolist(), r[cuts[:-1]].tolist()
            for new, i, j in zip(r, cuts, cuts[1:]):
                if new in buckets:
                    buckets[new] += at[i:j]
                else:
                    buckets[new] = at[i:j]
                    leaf[new >> 6] |= 1 << (new & 63)
                    middle[new >> 12] |= 1 << ((new >> 6) & 63)
                    top |= 1 << (new >> 12)

        if (first := np.flatnonzero(rank >= 0)).size:
            push(first)
        # The same memory, for single positions.
        ids_v, nxt_v, prv_v, rank_v, alive_v = map(memoryview, (ids, nxt, prv, rank, alive))
        if self.known > PAIR_ENTRIES:
            self.pairs.clear()
            self.known = 0
        while top:
            i = (top & -top).bit_length() - 1
            j = (i << 6) | ((middle[i] & -middle[i]).bit_length() - 1)
            r = (j << 6) | ((leaf[j] & -leaf[j]).bit_length() - 1)
            bucket = buckets.pop(r)
            leaf[j] &= leaf[j] - 1
            if not leaf[j]:
                middle[i] &= middle[i] - 1
                if not middle[i]:
                    top &= top - 1
            if len(bucket) >= WIDE:
                at = np.unique(bucket)
                at = at[rank[at] == r]  # the rest is stale
                own = word[at]
                lead = np.ones(len(at), dtype=bool)
                lead[1:] = own[1:] != own[:-1]
                if 2 * lead.sum() >= len(at):
                    # One merge for each pre-token, the leftmost; others of this rank wait, as a lower rank may appear.
                    if len(later := at[~lead]):
                        push(later)
                    p = at[lead]
                    q = nxt[p]
                    after, before = nxt[q], prv[p]
                    ids[p], nxt[p], rank[q], rank[p], alive[q] = r, after, -1, -1, False
                    right = after >= 0
                    prv[after[right]] = p[right]
                    before = before[before >= 0]
                    at = np.concatenate((before, p[right]))
                    pairs = ids[at].astype(np.int64) * self.size + ids[np.concatenate((nxt[before], after[right]))]
                    kinds, which = np.unique(pairs, return_inverse=True)
                    rank[at] = np.array(self.pair_ranks((kinds // self.size).tolist(), (kinds % self.size).tolist()), dtype=np.int32)[which]
                    if len(at := at[rank[at] >= 0]):
                        push(at)
                    continue
                bucket = at.tolist()
            else:
                bucket.sort()
            for done, p in enumerate(bucket, 1):
                if rank_v[p] != r:
                    continue  # stale
                q = nxt_v[p]
                after, before = nxt_v[q], prv_v[p]
                ids_v[p], nxt_v[p], rank_v[q], rank_v[p], alive_v[q] = r, after, -1, -1, False
                lowest = r
                if after >= 0:
                    prv_v[after] = p
                for left, right in ((before, p), (p, after)):
                    if left < 0 or right < 0:
                        continue
                    [new] = self.pair_ranks([ids_v[left]], [ids_v[right]])
                    rank_v[left] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            leaf[new >> 6] |= 1 << (new & 63)
                            middle[new >> 12] |= 1 << ((new >> 6) & 63)
                            top |= 1 << (new >> 12)
                        if new < lowest:
                            lowest = new
                if lowest < r and done < len(bucket):
                    # A lower rank has appeared: it comes first within this pre-token.
                    buckets[r] = bucket[done:]
                    leaf[r >> 6] |= 1 << (r & 63)
                    middle[r >> 12] |= 1 << ((r >> 6) & 63)
                    top |= 1 << (r >> 12)
                    break
        packed = ids[alive].astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(alive)[ends - 1])) * 4
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode_chunk(self, texts: list[str], find: Callable[[str], list[str]]) -> list[bytes]:
        """Packed ids of each text; find parts a text into pre-tokens.

        Distinct pre-tokens are numbered, so that a text is held as numbers until the new ones have been encoded.
        """
        if len(self.packed) > MEMO_ENTRIES:
            self.forget()
        number, known = self.number, len(self.packed)
        number.default_factory = count(known).__next__
        coded = [array("i", map(number.__getitem__, find(t))) for t in texts]
        new = list(islice(number, known, None))
        raw = [t.encode() for t in new]
        self.packed += [b""] * len(new)
        slow = []
        for i, t in enumerate(raw, known):
            whole = self.ranks.get(t)
            if whole is None:
                slow.append(i)
            else:
                self.packed[i] = whole.to_bytes(4, "little")
        if slow:
            for i, ids in zip(slow, self.merge([raw[i - known] for i in slow])):
                self.packed[i] = ids
        out = [b"".join(map(self.packed.__getitem__, c)) for c in coded]
        if any(len(t) > MEMO_KEY_CHARS for t in new):  # very long ones would fill the memo
            self.forget()
        return out

    def forget(self) -> None:
        """Empties the memo."""
        self.number.clear()
        self.packed.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> RankQueueEncoder:
    """One for each Python worker and file."""
    return RankQueueEncoder(load_ranks(path))


def _chunks(texts: list) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for t in texts:
        chunk.append(t or "")
        chars += len(chunk[-1])
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def _encoded(enc: RankQueueEncoder, pattern: str, texts: list) -> list[bytes]:
    import regex

    find = regex.compile(pattern).findall
    return [ids for chunk in _chunks(texts) for ids in enc.encode_chunk(chunk, find)]


def _decoded(enc: RankQueueEncoder, packed: list) -> list[bytes]:
    token = enc.tokens.__getitem__
    return [b"".join(map(token, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in packed]


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col: the token ids of each whole text, packed as little-endian uint32.

    Each match of pattern is encoded separately; there are no special tokens. A null or empty text has no ids
    (empty binary). Other columns pass through; a column already named ids_col is replaced.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_encoded(encoder(ranks_path), pattern, texts.tolist()), dtype=object)
        encoder(ranks_path).forget()  # the worker may go on with other work

    return df.withColumn(ids_col, packed(F.col(text_col)))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the bytes that packed ids stand for. Null ids decode to empty bytes; an unknown id raises."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series(_decoded(encoder(ranks_path), ids.tolist()), dtype=object)

    return df.withColumn(out_col, unpacked(F.col(ids_col)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ids as encode() and decoded as decode() do, in one pass through the same workers. Other columns pass through, whatever they are called."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = _encoded(encoder(ranks_path), pattern, texts.tolist())
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(_decoded(encoder(ranks_path), ids), dtype=object)})
        encoder(ranks_path).forget()

    out = packed(df, _coded=both(F.col(text_col)))
    return unpacked(out, df.columns, ids=F.col("_coded.ids"), decoded=F.col("_coded.decoded"))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of documents."""
    coded = round_trip(docs.select("doc_id", "text"), ranks_path, pattern)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
