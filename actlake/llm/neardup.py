"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct word shingles. Equal sets form classes, and only a class's smallest id goes on. Its
signature has SYMBOLS min-hashes of 16 bits each. Two signatures may differ in at most ERRORS symbols; signatures are
split into chunks so few that, by the pigeonhole principle, such a pair has a chunk with at most one differing
symbol. Each document is therefore indexed under every chunk less any one symbol: a pair within the threshold meets
under at least one of these keys, always. Of pairs that meet, those that differ in at most NEAR symbols are confirmed
on the full sets, whatever the number of documents under their key. At similarity 0.8 the number of differing symbols
is binomial(64, 0.2): 32 are exceeded by one such pair in some 50 million, and as few meet under no key; pairs that
are more alike miss far more rarely.

Groups of any size are joined without listing their pairs. First a document is compared with the smallest id under
any of its keys; then, outside its key's largest component, with a few pivots inside it. This joins nearly all that
belong together. What is left outside is compared with all members of its key: in a join where a key has few members;
else with the signatures of the whole largest component and of the others outside it, block by block inside tasks,
which confirm what is near and emit links only. The members of a key that is shared by very many are dealt to several
tasks in every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlake.llm.common import Workspace, bounded_batches, hot_keys, spread_join
from actlake.llm.components import components

SYMBOLS, ERRORS, CHUNKS = 64, 25, 13  # CHUNKS * 2 > ERRORS
NEAR = 32  # symbols in which a pair that meets may differ before it is confirmed
#: Pivots of a key and of a document; members of a key that are paired by a join; documents of a block otherwise.
KEY_PIVOTS, PIVOTS, FEW, BLOCK = 4, 8, 32, 512
#: Pairs that are confirmed together; a document with more is dealt to several groups.
GROUP = 256
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_FACTORS = np.random.default_rng(7).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: words of [^\\x20\\x09-\\x0D]+, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; without words there is none.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    width = min(words, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = (acc ^ (acc >> np.uint64(31))) * _MIX + h[j : n - width + 1 + j]
    acc ^= acc >> np.uint64(33)
    acc *= _MIX
    return np.unique(acc ^ (acc >> np.uint64(29)))


def signature(hashes: np.ndarray) -> bytes:
    """SYMBOLS little-endian 16-bit symbols, each taken from the least product of the hashes with an odd factor."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS).min(axis=0))
    return ((least * _MIX) >> np.uint64(48)).astype("<u2").tobytes()


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, words)
                counts.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sigs.append(signature(own))
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sigs, pa.binary())], names=["id", "n", "h1", "h2", "sig"])

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: id, sig. Output: key, id for each chunk less one symbol."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
        for chunk in np.array_split(np.arange(SYMBOLS), CHUNKS):
            for gone in chunk:
                acc = np.full(len(sigs), int(gone) + 1, np.uint64)
                for i in chunk:
                    if i != gone:
                        acc = (acc ^ (acc >> np.uint64(31))) * _MIX + sigs[:, i]
                acc = (acc ^ (acc >> np.uint64(33))) * _MIX
                yield pa.RecordBatch.from_arrays([pa.array((acc ^ (acc >> np.uint64(29))).view(np.int64)), batch.column(0)], names=["key", "id"])


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(-1, SYMBOLS) for s in (a, b))
    return pd.Series((x != y).sum(axis=1).astype("int32"))


def _confirm(ws: Workspace, pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b of the pairs whose sets have percent * union <= 100 * intersection. pairs: distinct a < b."""
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = ws.save(pairs.join(side("a"), "a").join(side("b"), "b").where(_distance("sig_a", "sig_b") <= NEAR).select("a", "b").distinct())
    groups = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    right = near.join(groups, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "part", "b", "text_b")
    left = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select(F.col("a").alias("own"), F.col("part").alias("own_part"), "text_a")

    def linked(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found: list[int] = []
        sets = [shingles(t, words) for t in ours["text_a"].drop_duplicates()]
        for b, text in zip(theirs["b"], theirs["text_b"]):
            other = shingles(text, words)
            for own in sets:
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common and 100 * common >= percent * (len(own) + len(other) - common):
                    found.append(b)
                    break
        return pd.DataFrame({"a": [theirs["a"].iloc[0]] * len(found) if found else [], "b": found}, dtype="int64")

    return ws.save(left.groupBy("own", "own_part").cogroup(right.groupBy("a", "part")).applyInPandas(linked, "a long, b long").distinct())


def _outside(ws: Workspace, members: DataFrame, component: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Members of keys that hold several components, with key, id, component, top (the key's largest), largest (its members) and n."""
    placed = members.join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.max("n").alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return ws.save(spread_join(placed, keys, ["key"], hot, ["id"]))


def _few(found: DataFrame) -> DataFrame:
    """a, b of different components under keys of few members."""
    few = found.where(F.col("n") <= FEW)
    pairs = few.where("component <> top").select("key", F.col("id").alias("x"), F.col("component").alias("cx")).join(few.select("key", F.col("id").alias("y"), F.col("component").alias("cy")), "key").where("cx <> cy")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _families(ws: Workspace, found: DataFrame, component: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links under keys of many members: of each document outside its key's largest component (the family) with all in
    the family and with all others outside it. One link is returned for a document and a component.

    Both sides are dealt to blocks. A task compares a document's signature with its whole block at once, and counts the
    intersections of the full sets for those that are near.
    """
    many = found.where(F.col("n") > FEW)
    outside = ws.save(many.where("component <> top").select(F.col("top").alias("family"), "id", "component").distinct())
    tops = outside.select("family").distinct()
    inside = component.join(tops, F.col("component") == F.col("family")).select("family", "id", "component").unionByName(tops.select("family", F.col("family").alias("id"), F.col("family").alias("component")))
    everyone = outside.unionByName(inside)
    blocks = lambda df, name: df.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = ws.save(blocks(outside, "turns").join(blocks(everyone, "parts"), "family"))
    signed = texts.join(sigs, "id")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = outside.join(sizes, "family").withColumn("turn", deal("turns")).select("family", "turn", "id", "component", each("parts", "part")).join(signed, "id")
    right = everyone.join(sizes, "family").withColumn("part", deal("parts")).select("family", "part", "id", "component", each("turns", "turn")).join(signed, "id")
    right = right.select(F.col("family").alias("family2"), F.col("turn").alias("turn2"), F.col("part").alias("part2"), F.col("id").alias("id2"), F.col("component").alias("component2"), F.col("text").alias("text2"), F.col("sig").alias("sig2"))

    def linked(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(ours) and len(theirs):
            matrix = lambda packed: np.frombuffer(b"".join(packed), "<u2").reshape(-1, SYMBOLS)
            marks, ids, components, there = matrix(theirs["sig2"]), theirs["id2"].to_numpy(), theirs["component2"].to_numpy(), theirs["text2"].tolist()
            sets: dict[int, np.ndarray] = {}
            for text, i, c, mark in zip(ours["text"], ours["id"], ours["component"], matrix(ours["sig"])):
                near = np.flatnonzero(((marks != mark).sum(axis=1) <= NEAR) & (components != c))
                if not len(near):
                    continue
                own, done = shingles(text, words), set()
                for j in near.tolist():
                    if components[j] in done:
                        continue  # one link to a component is enough
                    if j not in sets:
                        sets[j] = shingles(there[j], words)
                    both = own[np.minimum(np.searchsorted(own, sets[j]), len(own) - 1)] == sets[j]
                    common = int(both.sum())
                    if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                        done.add(components[j])
                        a.append(min(i, ids[j]))
                        b.append(max(i, ids[j]))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return ws.save(left.groupBy("family", "turn", "part").cogroup(right.groupBy("family2", "turn2", "part2")).applyInPandas(linked, "a long, b long").distinct())


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    return component.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(links)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id) of each row.

    Documents are linked whose shingle sets have a Jaccard similarity of at least percent / 100, counted exactly.
    Null, empty and blank texts have no shingles and no links. Rows that share an id are one document in links. A row
    with a null id takes no part: component_id null, kept. An empty table gives an empty result. Very long texts are read
    whole; other columns aren't read, whatever they are called.
    """
    ws = Workspace(docs.sparkSession, "near-dup")
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = ws.save(own.mapInArrow(_signed(words), "id long, n long, h1 long, h2 long, sig binary"))
    classes = ws.save(signed.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    sigs = classes.select("id", "sig")

    keyed = sigs.mapInArrow(_indexed, "key long, id long")
    sizes = ws.save(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").drop("hi"))
    hot = hot_keys(sizes, ["key"])
    members = ws.save(spread_join(keyed, sizes.drop("n"), ["key"], hot, ["id"]))
    texts = ws.save(own.join(members.select("id").distinct(), "id", "left_semi"))
    stars = members.groupBy("id").agg(F.min("lo").alias("lo")).where("lo < id").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    component = components(ws, _confirm(ws, stars, sigs, texts, words, percent))
    found = _outside(ws, members, component, hot)
    many = found.where(F.col("n") > FEW)
    pivots = many.where("component = top").groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(KEY_PIVOTS)))).alias("pivots"))
    asked = spread_join(many.where("component <> top"), pivots, ["key"], hot, ["id"]).select("id", F.explode("pivots").alias("pivot"))
    some = asked.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("id", "pivot").alias("at"), "pivot"))), 1, PIVOTS).alias("own")).select("id", F.explode("own.pivot").alias("pivot"))
    links = _confirm(ws, some.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), sigs, texts, words, percent)
    component = components(ws, _joined(component, links))
    found = _outside(ws, found.select("key", "id"), component, hot)
    links = _confirm(ws, _few(found), sigs, texts, words, percent).unionByName(_families(ws, found, component, sigs, texts, words, percent))
    component = components(ws, _joined(component, links))
    of_class = classes.select("h1", "h2", "id").join(component, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(of_class, ["h1", "h2"], "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), found).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
