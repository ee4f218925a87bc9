"""Runs of repeated words: Crochemore's partition refinement over whole texts.

For lengths 1, 2, 3, ... the positions of a text are kept in classes: two positions are in one class if the same
`length` words begin at both. From one length to the next, classes are split by the classes of the following positions;
of the parts of a split class all but the largest are looked at again (smaller half), which bounds the work by
n log n. Members of a class are linked in ascending order. Neighbours whose distance equals the length begin a square,
and squares of one period that begin at consecutive positions are one run. All texts of a chunk are refined at once, as
arrays; a length with few changes is refined position by position.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import bounded_batches, packed, unpacked

#: Characters of text that are refined together.
CHUNK_CHARS = 4_000_000
#: Lengths whose squares are found by a scan of all links; beyond, links wait under their distance.
SCANNED = 4
#: Fewer changed positions than this are refined one by one.
FEW = 48


class Refinement:
    """Classes of positions of equal words, for several texts laid end to end.

    words: a number for each word, where each text is followed by a number of its own that no other place has (an end).
    text: the text of each position. longest: for each text, the longest period that matters.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, ends: np.ndarray, longest: np.ndarray):
        n = self.n = len(words)
        self.ends = np.zeros(n, dtype=bool)
        self.ends[ends] = True
        self.longest = longest[text]
        self.cls = pd.factorize(text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)[0].astype(np.int64)
        self.size = np.zeros(2 * n + 1, dtype=np.int64)  # a class for each split at most, and each split makes one of a position at least
        self.head = np.full(2 * n + 1, -1, dtype=np.int64)
        self.classes = int(self.cls.max(initial=-1)) + 1
        self.size[: self.classes] = np.bincount(self.cls, minlength=self.classes)
        self.nxt, self.prv = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        order = np.argsort(self.cls, kind="stable")
        self._link(order)
        self.changed = np.arange(n)  # positions of classes by which others are split next
        self.waiting: defaultdict[int, list[int]] = defaultdict(list)
        self.length = 1

    def _link(self, at: np.ndarray) -> None:
        """Links positions that are sorted by class and position."""
        if not len(at):
            return
        same = self.cls[at[1:]] == self.cls[at[:-1]]
        self.nxt[at], self.prv[at] = -1, -1
        a, b = at[:-1][same], at[1:][same]
        self.nxt[a], self.prv[b] = b, a
        first = at[np.concatenate(([True], ~same))]
        self.head[self.cls[first]] = first

    def _wait(self, at: np.ndarray) -> None:
        """Links from these positions are looked at when the length reaches their distance."""
        if self.length < SCANNED or not len(at):
            return
        at = at[self.nxt[at] >= 0]
        gap = self.nxt[at] - at
        fits = (gap > self.length) & (gap <= self.longest[at])
        for g, i in zip(gap[fits].tolist(), at[fits].tolist()):
            self.waiting[g].append(i)

    def squares(self) -> np.ndarray:
        """Positions, ascending, at which a square of period `length` begins whose half isn't a repetition itself."""
        if self.length <= SCANNED:
            at = np.flatnonzero((self.nxt - np.arange(self.n) == self.length) & (self.longest >= self.length))
            if self.length == SCANNED:
                self._wait(np.arange(self.n))
            return at
        at = np.unique(np.array(self.waiting.pop(self.length, []), dtype=np.int64))
        return at[self.nxt[at] - at == self.length]

    def refine(self) -> None:
        """From classes of `length` words to those of one word more."""
        self.length += 1
        i = self.changed
        i = i[i > 0]
        i = i[~self.ends[i - 1]]
        i = i[(self.size[self.cls[i - 1]] > 1) & (self.longest[i] >= self.length)]
        self.changed = self._refine_many(i) if len(i) >= max(FEW, 1) else self._refine_few(i.tolist())

    def _members(self, c: int) -> list[int]:
        out, i, nxt = [], int(self.head[c]), memoryview(self.nxt)
        while i >= 0:
            out.append(i)
            i = nxt[i]
        return out

    def _refine_many(self, i: np.ndarray) -> np.ndarray:
        j = i - 1
        old, by = self.cls[j], self.cls[i]
        order = np.lexsort((j, by, old))
        j, old, by = j[order], old[order], by[order]
        lead = np.ones(len(j), dtype=bool)  # the first of a group: same class, followed by the same class
        lead[1:] = (old[1:] != old[:-1]) | (by[1:] != by[:-1])
        starts = np.flatnonzero(lead)
        sizes = np.diff(np.append(starts, len(j)))
        owner = old[starts]
        first = np.ones(len(starts), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]
        which = np.cumsum(first) - 1  # of the classes that are met
        met = owner[first]
        rest = self.size[met] - np.add.reduceat(sizes, np.flatnonzero(first))
        by_size = np.lexsort((sizes, which))
        largest = by_size[np.append(np.flatnonzero(first)[1:], len(starts)) - 1]  # its largest group
        stays = np.zeros(len(starts), dtype=bool)
        stays[largest[rest == 0]] = True  # nothing else is left, so the largest group keeps the class
        new = np.full(len(starts), -1, dtype=np.int64)
        new[~stays] = self.classes + np.arange((~stays).sum())
        self.classes += int((~stays).sum())
        # Parts to look at next: all but the largest.
        again = ~stays
        swap = (rest > 0) & (sizes[largest] > rest)
        again[largest[swap]] = False
        group = np.repeat(np.arange(len(starts)), sizes)
        moved = ~stays[group]
        at, to = j[moved], new[group][moved]
        if len(at):
            self._take_out(at)
            self.cls[at] = to
            self.size[new[~stays]] = sizes[~stays]
            self._link(at)
            self._wait(at)
        np.subtract.at(self.size, owner[~stays], sizes[~stays])
        left = [m for c in met[swap].tolist() for m in self._members(c)]
        return np.sort(np.concatenate((j[again[group]], np.array(left, dtype=np.int64))))

    def _take_out(self, at: np.ndarray) -> None:
        """Takes positions out of their classes' links."""
        cls = self.cls[at]
        order = np.lexsort((at, cls))
        at, cls = at[order], cls[order]
        joined = self.nxt[at[:-1]] == at[1:]
        a, b = at[np.concatenate(([True], ~joined))], at[np.concatenate((~joined, [True]))]  # first and last of each stretch
        before, after, own = self.prv[a], self.nxt[b], self.cls[a]
        has, ends = before >= 0, after >= 0
        self.nxt[before[has]] = after[has]
        self.prv[after[ends]] = before[ends]
        self.head[own[~has]] = after[~has]
        self._wait(before[has])

    def _refine_few(self, i: list[int]) -> np.ndarray:
        cls, size, nxt, prv, head, longest = map(memoryview, (self.cls, self.size, self.nxt, self.prv, self.head, self.longest))
        groups: dict[int, dict[int, list[int]]] = {}
        for k in i:
            groups.setdefault(cls[k - 1], {}).setdefault(cls[k], []).append(k - 1)
        again: list[int] = []
        late = self.length >= SCANNED

        def wait(a: int, b: int) -> None:
            if late and self.length < b - a <= longest[a]:
                self.waiting[b - a].append(a)

        for c, parts in groups.items():
            found = sorted(parts.values(), key=len)
            rest = size[c] - sum(map(len, found))
            if not rest:
                found.pop()  # the largest keeps the class
            for part in found:
                new = self.classes
                self.classes += 1
                size[new], head[new] = len(part), part[0]
                size[c] -= len(part)
                last = -1
                for p in part:
                    before, after = prv[p], nxt[p]
                    if before >= 0:
                        nxt[before] = after
                        if after >= 0:
                            wait(before, after)
                    else:
                        head[c] = after
                    if after >= 0:
                        prv[after] = before
                    cls[p], prv[p], nxt[p] = new, last, -1
                    if last >= 0:
                        nxt[last] = p
                        wait(last, p)
                    last = p
            if rest and found and len(found[-1]) > rest:
                found.pop()
                found.append(self._members(c))
            for part in found:
                again += part
        return np.array(sorted(again), dtype=np.int64)


def runs_of(texts: list[list], min_length: int, min_exponent: int) -> list[np.ndarray]:
    """For each text (a list of words): rows of start, length, period of its runs, by start, then period."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    able = [k for k, words in enumerate(texts) if len(words) >= max(min_length, min_exponent)]
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    if not able:
        return out
    flat = array("q")
    for k in able:
        flat.extend(map(number.__getitem__, texts[k]))
        flat.append(-1)
    words = np.frombuffer(flat, dtype=np.int64).copy()
    sizes = np.array([len(texts[k]) for k in able])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    words[ends] = len(number)  # a text has one end, so it is no other position's
    text = np.repeat(np.arange(len(able)), sizes + 1)
    state = Refinement(words, text, ends, sizes // min_exponent)
    found = []
    while True:
        at, q = state.squares(), state.length
        if len(at):
            cuts = np.flatnonzero(np.diff(at) != 1)
            first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
            length = last - first + 2 * q
            keep = length >= max(min_length, min_exponent * q)
            found += zip(first[keep].tolist(), length[keep].tolist(), [q] * int(keep.sum()))
        if not len(state.changed):
            break
        state.refine()
    if found:
        rows = np.array(sorted(found), dtype=np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        own = text[rows[:, 0]]
        rows[:, 0] -= starts[own]
        for k in np.unique(own).tolist():
            out[able[k]] = rows[own == k]
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words that no run holds after its first period, joined by a space."""
    if len(runs):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    return b" ".join(words)


def _chunks(texts: list) -> Iterator[list[list[bytes]]]:
    chunk, chars = [], 0
    for t in texts:
        chunk.append((t or "").encode().split())  # bytes are split at [\x20\x09-\x0D]
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def periodic_runs(df: DataFrame, text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """Adds n_words long, runs and collapsed of each whole text.

    Words are [^\\x20\\x09-\\x0D]+, compared exactly. runs: array of (start, length, period) of all stretches of words with
    smallest period `period` and length >= max(min_length, min_exponent * period) that can't be extended, by start, then
    period. collapsed: the words that no run holds after its first period, joined by one space.
    A null or empty text, or one without words, has no runs and an empty `collapsed`; a very long text is refined by
    itself, in memory in proportion to its words. Repeated rows have results each, an empty table has none. Other columns
    pass through, whatever they are called; a column named like a new one is replaced. min_exponent is 2 at least.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least once")
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, runs, kept = [], [], []
            for chunk in _chunks(texts.tolist()):
                rows = runs_of(chunk, min_length, min_exponent)
                n += map(len, chunk)
                runs += [[{"start": s, "length": m, "period": q} for s, m, q in r.tolist()] for r in rows]
                kept += [_collapsed(w, r).decode() for w, r in zip(chunk, rows)]
            yield pd.DataFrame({"n_words": pd.Series(n, dtype="int64"), "runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(kept, dtype=object)})

    out = packed(df, _found=found(F.col(text_col)))
    return unpacked(out, df.columns, n_words=F.col("_found.n_words"), runs=F.col("_found.runs"), collapsed=F.col("_found.collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by the checksum h of its id repeats itself: each word i >= a is the
    word a + (i - a) % p, with g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Null ids change nothing."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.struct(words.alias("w"), F.floor(h / 10).alias("g"))).alias("_h"))
    n, g = F.size("_h.w"), F.col("_h.g")
    chosen = chosen.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.expr("1 + (size(_h.w) - _a) div (3 + _h.g % 8)"))
    turned = F.expr("array_join(transform(_h.w, (w, i) -> if(i >= _a, _h.w[int(_a + (i - _a) % _p)], w)), ' ')")
    return chosen.select("doc_id", F.when(F.col("_a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli) and digests of all runs and of the collapsed text."""
    found = periodic_runs(planted(docs))
    best = F.expr("""get(array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1
        WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1
        WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END), 0)""")
    rows = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), rows.alias("_rows"), "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.col("_rows").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
