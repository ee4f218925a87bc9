"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Training text is counted in blocks inside tasks; sorted, summed blocks are shuffled as packed columns by the range of their
grams' 64-bit hashes, so every shard is about as large as any other, whatever words are frequent. A shard's task sums
equal grams, writes their hashes and counts as one file of sorted arrays to the shared folder, and passes on what the next
lower order and the contexts need: the count of a shorter gram is the number of distinct words before it, that of the
highest order is the number of occurrences. Files of a repeated task have names of their own, and only those of the
task that ended are in the model. Workers map the files, look up sorted queries, and so read only pages that they need.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.llm.common import Workspace, bounded_batches, packed, partitions, shared_dir, unpacked

#: Bytes of text that are hashed at once, grams that are summed before they are sent, characters of text for a shard at most.
BLOCK_BYTES, BLOCK_GRAMS, SHARD_CHARS = 1_000_000, 1_000_000, 16_000_000
#: Words from this length on are hashed by themselves: the polynomial hash is weak for very long ones.
LONG_WORD = 48
#: Word ids: the symbol before a text, any word that training lacks, then the words.
BEGIN, UNKNOWN, FIRST = 0, 1, 2
BLOCKS = "shard int, cols array<binary>"
SHARDS = "kind string, shard int, cols array<binary>, file string, types array<string>, stats array<bigint>"

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_END_OF_TEXT = np.uint64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of texts, all words of a block at once: differences of running sums of byte * base**place."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            power = lambda base: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base % 2**64, dtype=np.uint64))), dtype=np.uint64)
            self.up, self.down = power(_BASE), power(pow(_BASE, -1, 2**64))
        return self.up, self.down

    def block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of a block of bytes."""
        raw = _LOWER[raw]
        edge = np.diff(np.concatenate(([0], (~_SPACE[raw]).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = self._powers(len(raw) + 1)
        running = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=running[1:])
        hashes = mix((running[end] - running[start]) * down[start])
        if len(raw) > 4 * BLOCK_BYTES:
            self.up = self.down = np.ones(1, dtype=np.uint64)
        import xxhash

        for k in np.flatnonzero(end - start >= LONG_WORD).tolist():
            hashes[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes())
        return hashes, start

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of words, and the end of text after each text, in pieces: (hashes, text of each)."""
        parts = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts])  # the line feed after each text is its end
        start = 0
        while start < len(raw):
            stop = min(start + BLOCK_BYTES, len(raw))
            while stop < len(raw):  # to the next space
                at = np.flatnonzero(_SPACE[raw[stop : stop + 4096]])
                if len(at):
                    stop += int(at[0]) + 1
                    break
                stop = min(stop + 4096, len(raw))
            hashes, at = self.block(raw[start:stop])
            first, last = np.searchsorted(ends, [start, stop], side="right")  # texts that end here
            own = np.concatenate((np.searchsorted(ends, at + start, side="right"), np.arange(first, last)))
            order = np.argsort(own, kind="stable")  # the end after the words
            yield np.concatenate((hashes, np.full(last - first, _END_OF_TEXT)))[order], own[order]
            start = stop


def gram_keys(ids: list[np.ndarray]) -> np.ndarray:
    """A hash of each gram."""
    key = np.zeros(len(ids[0]), dtype=np.uint64)
    for column in ids:
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + column + np.uint64(1))
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def combined(keys: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each gram once, by ascending hash, with the sums of its values."""
    if not len(keys):
        return keys, ids, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], [c[order[first]] for c in ids], [np.add.reduceat(v[order], first) for v in values]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, planes of bytes apart, compressed."""
    import zstandard

    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(blob[0], -1).T).view(f"<u{blob[0]}").ravel().astype(np.uint64)


def dealt(keys: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray], shards: int) -> Iterator[tuple[int, list[bytes]]]:
    """Packed columns of each shard, from grams by ascending hash. Rows are ordered by words, which packs better."""
    own = shard_of(keys, shards)
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
    for start, stop in zip(at, [*at[1:], len(own)]):
        order = np.lexsort([c[start:stop] for c in reversed(ids)])
        cols = [c[start:stop][order] for c in ids + values]
        cols[0] = np.diff(cols[0], prepend=np.uint64(0))
        yield int(own[start]), [pack(c) for c in cols]


def gathered(blobs: list[list[bytes]], n_ids: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of ids and values of all blocks of a shard."""
    parts = [[unpack(c) for c in cols] for cols in blobs]
    for cols in parts:
        cols[0] = np.cumsum(cols[0], dtype=np.uint64)
    whole = [np.concatenate(cols) for cols in zip(*parts)]
    return whole[:n_ids], whole[n_ids:]


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> tuple[str, list[str]]:
    """Writes arrays one after another, each from a multiple of 8 bytes; gives the file and the arrays' types."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    files, path = _files(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    arrays = [x if k == 0 else x.astype(np.min_scalar_type(int(x.max(initial=0)))) for k, x in enumerate(arrays)]
    with files.open_output_stream(path) as out:
        for x in arrays:
            out.write(x.tobytes() + bytes(-x.nbytes % 8))
    return uri, [x.dtype.str for x in arrays]


def map_arrays(uri: str, types: list[str], n: int) -> list[np.ndarray]:
    """The arrays of a file: mapped where the folder is mounted, else read."""
    from pyarrow import fs

    files, path = _files(uri)
    if n == 0:
        return [np.zeros(0, dtype=t) for t in types]
    if isinstance(files, fs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        raw = np.frombuffer(files.open_input_file(path).read_buffer(), dtype=np.uint8)
    out, at = [], 0
    for t in map(np.dtype, types):
        out.append(raw[at : at + n * t.itemsize].view(t))
        at += -(-n * t.itemsize // 8) * 8
    return out


@dataclass
class Table:
    """Sorted hashes and values in shards by ranges of the hash."""

    shards: int
    files: dict[int, tuple[str, list[str], int]]

    @classmethod
    def of(cls, rows: list, shards: int) -> Table:
        return cls(shards, {r["shard"]: (r["file"], list(r["types"]), r["stats"][0]) for r in rows})

    def starts(self) -> dict[int, int]:
        """Rows in the shards before."""
        out, start = {}, 0
        for shard in sorted(self.files):
            out[shard] = start
            start += self.files[shard][2]
        return out


class Mapped:
    """A table's files in this worker, mapped when they are asked for."""

    def __init__(self, table: Table):
        self.table, self.open, self.starts = table, {}, table.starts()

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[np.ndarray]]]:
        """For each shard met: places in `keys` that are found, their rows in the shard, rows before the shard, and its values."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        own = shard_of(keys, self.table.shards)
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
        for start, stop in zip(at, [*at[1:], len(own)]):
            shard = int(own[start])
            if shard not in self.table.files:
                continue
            if shard not in self.open:
                self.open[shard] = map_arrays(*self.table.files[shard])
            known, *values = self.open[shard]
            row = np.searchsorted(known, keys[start:stop])
            row[row == len(known)] = 0
            hit = known[row] == keys[start:stop]
            yield order[start:stop][hit], row[hit], self.starts[shard], values

    def values(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key as doubles; zeros of those that aren't there."""
        width = max((len(types) - 1 for _, types, _ in self.table.files.values()), default=1)
        out = [np.zeros(len(keys)) for _ in range(width)]
        for at, row, _, values in self.find(keys):
            for x, v in zip(out, values):
                x[at] = v[row]
        return out

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each word and its count in training; UNKNOWN and 0 if it has none."""
        ids, counts = np.full(len(keys), UNKNOWN, dtype=np.uint64), np.zeros(len(keys), dtype=np.int64)
        for at, row, start, values in self.find(keys):
            ids[at] = row + (start + FIRST)
            counts[at] = values[0][row]
        return ids, counts


@dataclass
class Model:
    """Where a model's arrays are, and its few numbers."""

    order: int
    words: Table
    train_tokens: int
    vocabulary: int
    grams: dict[int, Table] = field(default_factory=dict)
    contexts: dict[int, Table] = field(default_factory=dict)
    #: For each order: discounts of grams that count 1, 2, and 3 or more.
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: Of single words: the sum of their counts, and how many count 1, 2, and 3 or more.
    unigrams: tuple[int, int, int, int] = (0, 0, 0, 0)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of grams that count 1 to 4; a half, one and one and a half where these numbers give none."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def _pieces(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    hasher = WordHasher()
    for batch in batches:
        yield from hasher.texts(batch.column(name).to_pylist())


def _blocks(rows: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.binary()))], ["shard", "cols"])


def _summed(parts: Iterator[list[np.ndarray]], keys_of: Callable[[list[np.ndarray]], np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks of grams that count their occurrences, summed over BLOCK_GRAMS of them."""
    held: list[list[np.ndarray]] = []

    def out() -> pa.RecordBatch:
        ids = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        return _blocks(list(dealt(*combined(keys_of(ids), ids, [np.ones(len(ids[0]), dtype=np.uint64)]), shards)))

    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) >= BLOCK_GRAMS:
            yield out()
    if held:
        yield out()


def _windows(pieces: Iterator[tuple[np.ndarray, np.ndarray]], words: Mapped, order: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """For each token: its gram of `order` ids (BEGIN before the text), the text it is in as the piece counts them, and its count in training.

    A text may go on in the next piece, which then knows its last words.
    """
    tail, last = np.full(order - 1, BEGIN, dtype=np.uint64), None
    for hashes, own in pieces:
        ids, counts = words.ids(hashes)
        n = len(ids)
        if not n:
            continue
        goes_on = last is not None and last == own[0] and len(tail) == order - 1
        before = tail if goes_on else np.full(order - 1, BEGIN, dtype=np.uint64)
        whole = np.concatenate((before, ids))
        first = np.concatenate(([not goes_on], own[1:] != own[:-1]))
        begins = np.maximum.accumulate(np.where(first, np.arange(n), -(order - 1)))  # where the own text begins; before the piece, as far as is known
        grams = []
        for back in range(order - 1, 0, -1):
            at = np.arange(n) - back
            grams.append(np.where(at >= begins, whole[at + order - 1], np.uint64(BEGIN)))
        yield [*grams, ids], own, counts
        ended, places = hashes[-1] == _END_OF_TEXT, np.arange(n - (order - 1), n)
        tail = np.where((places >= begins[-1]) & ~ended, whole[len(whole) - (order - 1) :], np.uint64(BEGIN))
        last = None if ended else own[-1]


def _shard_rows(rows: list[dict]) -> pa.Table:
    kinds = {"kind": pa.string(), "shard": pa.int32(), "cols": pa.list_(pa.binary()), "file": pa.string(), "types": pa.list_(pa.string()), "stats": pa.list_(pa.int64())}
    return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in kinds.items()})


def _words_shard(folder: str) -> Callable[[pa.Table], pa.Table]:
    def reduce(blocks: pa.Table) -> pa.Table:
        [hashes], values = gathered(blocks.column("cols").to_pylist(), 1)
        hashes, _, [n] = combined(hashes, [], values)
        file, types = write_arrays(folder, "words", [hashes, n])
        return _shard_rows([{"kind": "words", "shard": blocks.column("shard")[0].as_py(), "file": file, "types": types, "stats": [len(n), int(n.sum())]}])

    return reduce


def _grams_shard(folder: str, k: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    """Sums a shard's grams of k words; gives the file, and blocks of shorter grams and of contexts."""

    def reduce(blocks: pa.Table) -> pa.Table:
        ids, values = gathered(blocks.column("cols").to_pylist(), k)
        keys, ids, [n] = combined(gram_keys(ids), ids, values)
        file, types = write_arrays(folder, f"grams{k}", [keys, n])
        seen = [int((n == c).sum()) for c in (1, 2, 3, 4)]
        out = [{"kind": "grams", "shard": blocks.column("shard")[0].as_py(), "file": file, "types": types, "stats": [len(n), int(n.sum()), *seen]}]
        if k > 1:
            counts = [n, *((n == 1), (n == 2), (n >= 3))]
            for kind, part, numbers in (("shorter", ids[1:], [np.ones(len(n))]), ("context", ids[:-1], counts)):
                rows = combined(gram_keys(part), part, [x.astype(np.uint64) for x in numbers])
                out += [{"kind": kind, "shard": s, "cols": cols} for s, cols in dealt(*rows, shards)]
        return _shard_rows(out)

    return reduce


def _contexts_shard(folder: str, k: int) -> Callable[[pa.Table], pa.Table]:
    def reduce(blocks: pa.Table) -> pa.Table:
        ids, values = gathered(blocks.column("cols").to_pylist(), k - 1)
        keys, _, values = combined(gram_keys(ids), ids, values)
        file, types = write_arrays(folder, f"contexts{k}", [keys, *values])
        return _shard_rows([{"kind": "contexts", "shard": blocks.column("shard")[0].as_py(), "file": file, "types": types, "stats": [len(keys)]}])

    return reduce


def fit(docs: DataFrame, order: int = 2, text_col: str = "text") -> Model:
    """Learns from all whole texts: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, then the end of the text.

    Null and empty texts are an end only; repeated rows count each; an empty table gives a model in which every token has
    probability 1. Words are known by 64-bit hashes, and so are grams. The model's arrays stay in the shared folder.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    ws, folder = Workspace(spark, "lm"), f"{shared_dir(spark)}/lm-{uuid.uuid4().hex[:12]}"
    shards = max(partitions(spark), int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_CHARS))

    by_shard = lambda blocks, reduce: ws.save(blocks.groupBy("shard").applyInArrow(reduce, SHARDS))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(([hashes] for hashes, _ in _pieces(batches)), lambda ids: ids[0], shards)

    found = by_shard(rows.mapInArrow(count_words, BLOCKS), _words_shard(folder)).collect()  # a row a shard
    words = Table.of(found, shards)
    model = Model(order, words, sum(r["stats"][1] for r in found), sum(r["stats"][0] for r in found))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed((grams for grams, _, _ in _windows(_pieces(batches), Mapped(words), order)), gram_keys, shards)

    blocks = rows.mapInArrow(count_grams, BLOCKS)
    for k in range(order, 0, -1):
        made = by_shard(blocks, _grams_shard(folder, k, shards))
        found = made.where("kind = 'grams'").drop("cols").collect()  # a row a shard
        model.grams[k] = Table.of(found, shards)
        model.discounts[k] = discounts(*(sum(r["stats"][c] for r in found) for c in (2, 3, 4, 5)))
        if k > 1:
            contexts = made.where("kind = 'context'").select("shard", "cols")
            model.contexts[k] = Table.of(by_shard(contexts, _contexts_shard(folder, k)).collect(), shards)
            blocks = made.where("kind = 'shorter'").select("shard", "cols")
        else:
            size, total, n1, n2 = (sum(r["stats"][c] for r in found) for c in (0, 1, 2, 3))
            model.unigrams = (total, n1, n2, size - n1 - n2)
    return model


class Scorer:
    """A model in this worker."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Mapped(model.words)
        self.grams = {k: Mapped(t) for k, t in model.grams.items()}
        self.contexts = {k: Mapped(t) for k, t in model.contexts.items()}

    def probabilities(self, grams: list[np.ndarray]) -> np.ndarray:
        """P of the last word of each gram after the words before it."""
        model = self.model
        p = np.full(len(grams[-1]), 1 / (model.vocabulary + 1))
        for k in range(1, model.order + 1):
            d1, d2, d3 = model.discounts[k]
            part = grams[model.order - k :]
            n = self.grams[k].values(gram_keys(part))[0]
            if k == 1:
                total, n1, n2, n3 = (np.full(len(n), float(x)) for x in model.unigrams)
            else:
                values = self.contexts[k].values(gram_keys(part[:-1]))
                total, n1, n2, n3 = values if len(values) == 4 else [np.zeros(len(n))] * 4
            left = np.maximum(n - np.select([n == 0, n == 1, n == 2], [0, d1, d2], d3), 0)
            seen = total > 0
            p[seen] = (left[seen] + (d1 * n1[seen] + d2 * n2[seen] + d3 * n3[seen]) * p[seen]) / total[seen]
        return p

    def score(self, hasher: WordHasher, texts: list[str | None]) -> pd.DataFrame:
        n = len(texts)
        tokens, known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        base, score = np.zeros(n), np.zeros(n)
        whole = self.model.train_tokens + self.model.vocabulary + 1
        for grams, own, counts in _windows(hasher.texts(texts), self.words, self.model.order):
            add = lambda weights=None: np.bincount(own, weights, minlength=n)  # noqa: B023, E731
            tokens += add()
            known += np.bincount(own[counts > 0], minlength=n)
            base += add(np.log10((counts + 1) / whole))
            score += add(np.log10(self.probabilities(grams)))
        return pd.DataFrame({"n_tokens": tokens, "n_known": known, "base_score": base, "score": score})


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known (tokens that training has), base_score, score and perplexity of each whole text.

    score: log10 of the model's probability of the text and its end. base_score: the same of a model of single words with
    one added to each count. perplexity: 10 ** (-score / n_tokens). A null or empty text is its end only. Very long texts are
    scored in blocks. Repeated rows have results each, an empty table has none. Other columns pass through, whatever they
    are called; a column named like a new one is replaced.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, hasher = Scorer(model), WordHasher()
        for texts in batches:
            yield scorer.score(hasher, texts.tolist())

    out = packed(df, _scored=scored(F.col(text_col).cast("string")))
    new = {c: F.col(f"_scored.{c}") for c in ("n_tokens", "n_known", "base_score", "score")}
    return unpacked(out, df.columns, **new, perplexity=F.pow(F.lit(10.0), -new["score"] / new["n_tokens"]))


def perplexities(docs: DataFrame, order: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity: documents whose crc32(doc_id) mod 7 is 2 aren't learnt from. A null id is learnt from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    model = fit(docs.where("NOT held_out"), order)
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
