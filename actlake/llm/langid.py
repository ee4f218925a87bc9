"""Language identification by cross-parsing entropy.

Labelled text of each language is a reference, held as a suffix automaton. A text is parsed greedily into the longest
phrases that occur in the reference: the automaton follows the text until it has no transition, which ends a phrase. A
letter that the reference lacks is a phrase of its own. Fewer phrases mean a closer language. Phrases are normalised
as phrases * log2(length of the reference) / characters; the language that needs fewest wins, the first in order of
its name on ties.

The automata are arrays of transitions, and many stretches of text run through them side by side. Whole texts are
parsed: each stretch of SEGMENT characters is first parsed from its own start; then the parse of the stretch before
goes on into it until both begin a phrase at the same place, from where they are one. A stretch where that doesn't
happen hands its new end on to the next one, until nothing changes. So phrases cross the cuts, and their number is that
of a parse from the first character to the last.

Each letter of the references has a code of its own, whatever the scripts; letters that no reference has share one.
Every automaton knows the letters of its own reference only. It is a table of all transitions if it has up to DENSE
letters and all tables together fit into TABLE_BYTES, else a sorted list of those that exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import bounded_batches, held_out, packed, unpacked

#: Rows that a language's reference is taken from at most, characters of a reference, and rows of that length or less preferred.
ROWS, REFERENCE_CHARS, ROW_CHARS = 200, 30_000, 8_000
SEGMENT, DENSE, CHUNK_CHARS, TABLE_BYTES = 256, 62, 1_000_000, 64_000_000
#: Languages that are learnt at most: those with most rows; parts that a language's ids are ranked in.
LANGUAGES, PARTS = 1_000, 8
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, the code point of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (t := chr(c)).isalpha():
            out[c] = ord(low) if len(low := t.lower()) == 1 else c
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _edges(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton's transitions of each state; 0 is the first state, none leads back to it."""
    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return edges


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions [state, code]; 0 is the first state, and where no transition is: none leads back to it."""
    edges = _edges(codes)
    table = np.zeros((len(edges), width), _smallest(len(edges)))
    for state, own in enumerate(edges):
        for c, to in own.items():
            table[state, c] = to
    return table


def _smallest(n: int) -> type:
    """The smallest type of numbers below n, of those in use."""
    return np.uint16 if n <= 2**16 else np.uint32


class DenseAutomaton:
    """Codes: 0 to letters, then one for all others, then padding, which keeps the state."""

    def __init__(self, codes: list[int], letters: int):
        self.width = letters + 3
        t = suffix_automaton(codes, self.width)
        t[:, letters + 2] = np.arange(len(t))
        self.table = t.ravel()

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.table[state * self.width + codes]

    def first(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes]


class SparseAutomaton:
    """The same, with the transitions that exist, sorted by state and code."""

    def __init__(self, codes: list[int], letters: int):
        self.width, self.pad = letters + 3, letters + 2
        edges = _edges(codes)
        pairs = sorted((state * self.width + c, to) for state, own in enumerate(edges) for c, to in own.items())
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([to for _, to in pairs] + [0], np.int64)
        self.root = np.zeros(self.width, np.int64)
        for c, to in edges[0].items():
            self.root[c] = to

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + codes
        at = np.searchsorted(self.keys, key)
        return np.where(codes == self.pad, state, np.where(self.keys[at] == key, self.to[at], 0))

    def first(self, codes: np.ndarray) -> np.ndarray:
        return self.root[codes]


class CrossParser:
    """references: (language, text), in order of language. Codes: 0 for anything but letters, then the letters of all references, then one for all other letters, then padding."""

    def __init__(self, references: tuple[tuple[str, str], ...]):
        letters = _letters()
        seen = np.unique(np.concatenate([np.zeros(1, np.uint32), *(letters[_points(text)] for _, text in references)]))[1:]
        unknown, self.pad = len(seen) + 1, len(seen) + 2
        table = np.full(0x110000, unknown, _smallest(len(seen) + 3))
        table[seen] = np.arange(1, len(seen) + 1)
        self.letter = letters > 0
        self.code = np.where(self.letter, table[letters], 0).astype(table.dtype)
        self.names = [name for name, _ in references]
        self.automata, self.own, self.bits = [], [], []
        tables = sum(2 * len(text) * min(DENSE, len(seen)) * 4 for _, text in references) <= TABLE_BYTES
        for _, text in references:
            codes = self.code[_points(text)]
            held = np.setdiff1d(codes, [0])
            # The automaton's own code of each code; those of letters that its reference lacks are one.
            own = np.full(self.pad + 1, len(held) + 1, _smallest(len(held) + 3))
            own[0], own[held], own[self.pad] = 0, np.arange(1, len(held) + 1), len(held) + 2
            kind = DenseAutomaton if tables and len(held) <= DENSE else SparseAutomaton
            self.automata.append(kind(own[codes].tolist(), len(held)))
            self.own.append(own)
            self.bits.append(np.log2(max(2, len(text))))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases [text, language], characters and letters of each text."""
        points = _points("".join(texts))
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        letters = np.add.reduceat(np.append(self.letter[points], False).astype(np.int64), starts) * (sizes > 0)
        segments = np.maximum(1, -(-sizes // SEGMENT))
        grid = np.full(segments.sum() * SEGMENT, self.pad, self.code.dtype)
        first = np.cumsum(segments) - segments
        grid[np.arange(len(points)) + np.repeat(first * SEGMENT - starts, sizes)] = self.code[points]
        grid = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        # Stretches of one text follow each other; the first of each text has none before it.
        lead = np.zeros(grid.shape[1], bool)
        lead[first] = True
        out = np.zeros((len(texts), len(self.names)))
        for k, (automaton, own) in enumerate(zip(self.automata, self.own)):
            out[:, k] = np.add.reduceat(_parsed(automaton, own[grid], own[self.pad], lead), first)
        return out, sizes, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; UNKNOWN and 0 for null and for texts without letters."""
        out: list[tuple[str, float]] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_CHARS):
                size += len(texts[j] or "")
                j += 1
            found, sizes, letters = self.phrases([t or "" for t in texts[i:j]])
            bits = found * np.array(self.bits)
            # Phrases are divided by the characters in any case; the winner doesn't depend on that.
            gap = (bits - bits.min(axis=1, keepdims=True)) / np.mean(self.bits)
            weight = np.exp(-np.minimum(gap, 700))
            best = bits.argmin(axis=1)
            sure = weight.max(axis=1) / weight.sum(axis=1)
            out += [(self.names[b], float(p)) if n else (UNKNOWN, 0.0) for b, p, n in zip(best, sure, letters)]
            i = j
        return out


def _advance(automaton, state: np.ndarray, codes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The states after one character, and where it begins a phrase. State 0 is the end of a phrase."""
    to = automaton.step(state, codes)
    begins = (state == 0) | (to == 0)
    begins &= codes != pad
    return np.where(begins, automaton.first(codes), to).astype(np.int32), begins


def _parsed(automaton, grid: np.ndarray, pad: int, lead: np.ndarray) -> np.ndarray:
    """Phrases that begin in each column of the grid, where a column that doesn't lead goes on from the one before."""
    width = grid.shape[1]
    state = np.zeros(width, np.int32)
    begins = np.zeros(grid.shape, bool)
    for i, codes in enumerate(grid):
        state, begins[i] = _advance(automaton, state, codes, pad)
    phrases, end = begins.sum(axis=0, dtype=np.int32), state
    entered = np.zeros(width, np.int32)  # the state that each column's parse has begun with
    for turn in count():
        before = np.where(lead, 0, np.concatenate(([0], end[:-1])))
        open_ = np.flatnonzero(before != entered)
        if not len(open_):
            return phrases
        if turn >= 4:  # few are left: each waits for the one before it
            open_ = open_[~np.isin(open_ - 1, open_)]
        entered[open_] = before[open_]
        state, new = before[open_], np.zeros(len(open_), np.int32)
        for i in range(len(grid)):
            state, now = _advance(automaton, state, grid[i, open_], pad)
            old = begins[i, open_]
            # From a place where both parses begin a phrase they are the same.
            met = now & old
            begins[i, open_] = now
            new += now
            if met.any():
                at = open_[met]
                phrases[at] = new[met] + begins[i + 1 :, at].sum(axis=0, dtype=np.int32)
                rest = ~met
                open_, state, new = open_[rest], state[rest], new[rest]
                if not len(open_):
                    break
        phrases[open_], end[open_] = new, state


@lru_cache(maxsize=2)
def _parser(references: tuple[tuple[str, str], ...]) -> CrossParser:
    """One for each Python worker."""
    return CrossParser(references)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, chars: int = REFERENCE_CHARS, languages: int = LANGUAGES) -> tuple[tuple[str, str], ...]:
    """References from rows that have a language and aren't held out: at most `rows` rows and `chars` characters each.

    The sample's bounds are these parameters, `languages` among them (those with most rows are learnt). Ids are taken in the
    order of a hash, those of texts above ROW_CHARS after the others; of a text longer than `chars` a stretch is taken at
    a place that the hash draws. Rows that repeat an id and language count once, a text once for each language. Null
    ids, null and empty texts are left out.
    """
    text, at = F.col(text_col).cast("string"), F.xxhash64(F.lit(11), F.col(id_col))
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    start = F.pmod(at, F.greatest(F.length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), (F.length(text) > ROW_CHARS).alias("long"), at.alias("at"), F.substring(text, start, F.lit(chars)).alias("text"))
    ids = usable.groupBy("lang", "id", "at").agg(F.min("long").alias("long"), F.count(F.lit(1)).alias("n"))
    known = ids.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    # A language's ids are ranked in PARTS parts first: at most PARTS * rows of them meet in one task.
    ranked = ids.join(F.broadcast(known), "lang").withColumn("part", F.pmod("at", F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("long", "at", "id"))).where(F.col("n") <= rows)
    chosen = F.broadcast(ranked.select("lang", "id", "n"))  # at most languages * rows
    picked = usable.select("lang", "id", "text").join(chosen, ["lang", "id"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    parts: dict[str, dict[str, int]] = {}
    for r in _prefixes(picked, chars).collect():  # at most twice `chars` characters for each of at most `languages` languages
        parts.setdefault(r["lang"], {}).setdefault(r["text"], r["n"])
    return tuple((lang, "\n".join(t for t, _ in sorted(own.items(), key=lambda x: x[1]))[:chars]) for lang, own in sorted(parts.items()))


def _prefixes(picked: DataFrame, chars: int) -> DataFrame:
    """lang, n, text of the first rows of each language that make up `chars` characters."""
    before = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return picked.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("before") < chars).select("lang", "n", "text")


def identify(docs: DataFrame, references: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1). Without references all are UNKNOWN with score 0.

    Null texts and texts without a letter are UNKNOWN with score 0; ties go to the first language by name. Other
    columns pass through, whatever they are called; columns with these two names are replaced. Repeated rows are judged
    one by one. An empty table gives an empty result.
    """

    bounded_batches(docs.sparkSession)

    shared = docs.sparkSession.sparkContext.broadcast(references)  # bounded by learn()'s parameters

    @F.pandas_udf("lang_pred string, score double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        references = shared.value
        for texts in batches:
            rows = _parser(references).predict(texts.tolist()) if references else [(UNKNOWN, 0.0)] * len(texts)
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    out = packed(docs, _found=found(F.col(text_col).cast("string")))
    return unpacked(out, docs.columns, lang_pred=F.col("_found.lang_pred"), score=F.col("_found.score"))
