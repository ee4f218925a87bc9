"""I-Match document fingerprints. Built-in functions only.

Terms whose inverse document frequency lies in a band form the lexicon: a term must be in at least a share RARE of the
documents (two at least) and in at most a share COMMON. Terms are known by 61-bit hashes of theirs. A document's terms
that are in the lexicon are made distinct, sorted and hashed; besides the whole lexicon this is done for randomised subsets of it, so
that a few changed terms leave some hashes as they were. Subsets come in levels of falling density, one term in 2 to
one in 1,024, SEEDS subsets a level, each nested in the one before. Sparse levels tell long documents apart, dense ones
short ones. A document with fewer than FEW terms in the band gets a wider band: its rarer terms count as well.

The band is set by document frequencies alone. The lexicon is a table that the documents' terms are joined with: it is
broadcast if its counted size allows, else joined by a shuffle that deals frequent terms to several tasks, with the same
result. The text is shuffled once,
to bring each document's successor next to it; terms are joined and gathered again where the text then is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import Workspace, hot_keys, partitions, spread_join

#: Shares of the documents that a term of the band is in at least and at most; terms of a document that do without rarer ones.
RARE, COMMON, FEW = 1e-4, 0.2, 4
#: A lexicon of more terms isn't broadcast; a term takes some 32 bytes.
BROADCAST_TERMS = 2_000_000
#: Documents of a task whose terms are gathered in memory; beyond, Spark sorts. The terms of a task's texts take about as much as the texts.
GATHERED = 16_384
#: A level keeps the terms whose draw ends in so many zero bits; subsets of a level.
LEVEL_BITS, SEEDS = (1, 2, 4, 6, 8, 10), 8
LEVELS = len(LEVEL_BITS)
BREAK = r"[^\p{L}\p{N}]+"


#: Flags beside a term's hash: of a document's text, of its edited text, too rare for the band.
OWN, EDITED, RARER, FLAGS = 1, 2, 4, 7


def _bits(value: int) -> Column:
    """A 64-bit pattern as a long."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits; their lowest 3 bits are 0."""
    words = F.filter(F.split(F.lower(text), BREAK), lambda t: t != "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t).bitwiseAND(_bits((1 << 64) - 1 - FLAGS))))


def lexicon(docs: DataFrame, text_col: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """term, df and above: false for terms in the band, true for more frequent ones; rarer terms are left out.

    Counted over all documents; partial counts come before the shuffle. There are at most (mean number of distinct
    terms of a document) / rare terms, and that divided by common above the band.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # In a corpus of a few documents every share is that of one document: two are no common term yet.
    return counts.where(F.col("df") >= max(2.0, rare * n)).select("term", "df", (F.col("df") > max(common * n, 2.0)).alias("above"))


def hashed(df: DataFrame, own: str, fallback: str, out_col: str) -> DataFrame:
    """Adds out_col, the fingerprint of the sorted term hashes in column own: of all and of all subsets, 8 hex digits each, '-' where a subset is empty.

    Without terms it is '=' and the fallback. Seeds draw by 10 bits each of the hash itself, the last ones of a hash of
    it. Each subset is a column, so that the next one is drawn from it and not from the start.
    """
    said = lambda terms: F.when(F.size(terms) > 0, F.lpad(F.hex(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")).otherwise(F.lit("-"))
    before = [own] * SEEDS
    made, slots = [], []
    for level, bits in enumerate(LEVEL_BITS):
        new = []
        for seed in range(SEEDS):
            mask, drawn = _bits(((1 << bits) - 1) << (3 + 10 * (seed % 6))), f"_drawn{seed}_{level}"
            bits_of = (lambda t: t) if seed < 6 else (lambda t: F.xxhash64(t))
            new.append(F.filter(before[seed], lambda t: bits_of(t).bitwiseAND(mask) == 0).alias(drawn))  # noqa: B023
            before[seed] = drawn
            slots.append(drawn)
        df = df.select("*", *new)
        made += slots[-SEEDS:]
    mark = F.array_join(F.array(said(F.col(own)), *(said(F.col(c)) for c in slots)), ",")
    return df.withColumn(out_col, F.when(F.size(own) > 0, mark).otherwise(F.concat(F.lit("="), F.col(fallback)))).drop(*made)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the levels that at least half of the subsets of have terms in either, the best one's share of equal hashes; 1 for equal fingerprints.

    The hash of the whole lexicon makes fingerprints equal or not, it isn't a level.
    """
    x, y = F.split(a, ","), F.split(b, ",")
    pairs = F.arrays_zip(F.slice(x, 2, LEVELS * SEEDS), F.slice(y, 2, LEVELS * SEEDS))
    same = F.transform(pairs, lambda p: F.when((p["0"] == "-") & (p["1"] == "-"), F.lit(None).cast("double")).otherwise((p["0"] == p["1"]).cast("double")))

    def level(i: Column) -> Column:
        own = F.filter(F.slice(same, i * SEEDS + 1, SEEDS), lambda v: v.isNotNull())
        return F.when(F.size(own) * 2 >= SEEDS, F.aggregate(own, F.lit(0.0), lambda s, v: s + v) / F.size(own)).otherwise(0.0)

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level))
    return F.when(a == b, 1.0).when(a.startswith("=") | b.startswith("="), 0.0).otherwise(best)


def stretches(df: DataFrame, order_col: str) -> DataFrame:
    """Adds _to (a stretch of the order) and _copy: each stretch holds its rows, and as _copy = 1 the first rows of the next (the last: of the first).

    The order's range is cut at quantiles into many stretches; each is a group of one window later on. So one shuffle
    brings successors together, and no task sees more than a few stretches. Null keys come last, in one stretch, and
    rows that share a key are in one stretch.
    """
    spark = df.sparkSession
    n = 4 * partitions(spark)
    key = F.col(order_col)
    cuts = sorted(set(df.agg(F.percentile_approx(order_col, [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    # The stretch of a key is the number of cuts below it: counted among every step-th cut, then within one step.
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    below = lambda edges: F.size(F.filter(edges, lambda e: e < key))
    coarse = below(array(cuts[step - 1 :: step])) * step
    at = F.when(key.isNull(), len(cuts) + 1).otherwise(coarse + below(F.slice(array(cuts), coarse + 1, F.lit(step))))
    firsts = sorted((r["s"], r["k"]) for r in df.select(at.alias("s"), key.alias("k")).groupBy("s").agg(F.min("k").alias("k")).collect())  # one row a stretch
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    heads = F.broadcast(spark.createDataFrame([(s, k, b) for (s, k), b in zip(firsts, before)], "_stretch int, _first long, _before int"))
    rows = df.withColumn("_stretch", at).join(heads, "_stretch")
    copies = F.array(F.struct(F.col("_stretch").alias("to"), F.lit(0).alias("copy")), F.struct(F.when(key.eqNullSafe(F.col("_first")), F.col("_before")).alias("to"), F.lit(1).alias("copy")))
    sent = rows.withColumn("_sent", F.explode(F.filter(copies, lambda x: x["to"].isNotNull())))
    return sent.withColumn("_to", F.col("_sent.to")).withColumn("_copy", F.col("_sent.copy")).drop("_sent", "_stretch", "_first", "_before")


def compare(docs: DataFrame, rare: float = RARE, common: float = COMMON, few: int = FEW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of documents.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document.
    Null texts count as empty. Rows with one doc_id follow each other in the order of their texts, null ids come last.
    Equal texts have equal fingerprints, repeated rows included. Other columns don't matter, whatever they are called.
    An empty table gives an empty result. Documents with fewer than `few` terms in the band use their rarer terms too; with
    0 the band is never left, and texts without a term in it are fingerprinted by a hash of the whole text.
    """
    ws = Workspace(docs.sparkSession, "i-match")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = ws.save(lexicon(rows, rare=rare, common=common))
    small = known.count() <= BROADCAST_TERMS
    # A term of a great many documents is one key of the join: its rows are dealt to several tasks.
    hot = None if small else hot_keys(known.select("term", F.col("df").alias("n")), ["term"])
    known = known.drop("df")
    docs.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GATHERED))

    order = Window.partitionBy("_to").orderBy("_copy", F.asc_nulls_last("doc_id"), "text")
    rows = stretches(rows, "doc_id").withColumn("next_text", F.lead("text").over(order)).withColumn("_n", F.row_number().over(order))
    length = F.length("text")
    cut = F.floor(length / 4).cast("int")
    edited = F.when(F.col("_copy") == 0, F.concat(F.substring("text", F.lit(1), length - cut), F.substring("next_text", F.lit(1), cut))).otherwise("")
    whole = lambda c: F.unhex(F.substring(F.sha2(F.lower(c).cast("binary"), 256), 1, 32))
    about = F.col("_copy"), F.col("doc_id"), F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), whole("text").alias("own_hash"), whole("edited").alias("edited_hash")
    rows = rows.withColumn("edited", edited)
    rows = rows.select("_to", "_n", *about, terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("changed"))
    flagged = lambda terms, flags: F.transform(terms, lambda t: t.bitwiseOR(F.lit(flags).cast("long")))
    parts = F.concat(flagged(F.array_intersect("own", "changed"), OWN | EDITED), flagged(F.array_except("own", "changed"), OWN), flagged(F.array_except("changed", "own"), EDITED))
    keys = ["_to", "_n", "_copy", "doc_id", "n_chars", "sha", "own_hash", "edited_hash"]
    each = rows.select(*keys, F.explode_outer(parts).alias("code")).withColumn("term", F.col("code").bitwiseAND(_bits((1 << 64) - 1 - FLAGS)))
    met = each.join(F.broadcast(known), "term", "left") if small else spread_join(each, known, ["term"], hot, ["_to", "_n"], "left")
    code = F.when(F.col("above").isNull(), F.col("code").bitwiseOR(F.lit(RARER).cast("long"))).when(~F.col("above"), F.col("code"))
    docs_ = met.groupBy(*keys).agg(F.collect_list(code).alias("codes"))

    def chosen(flag: int) -> Column:
        """The document's terms in the band, or all but the common ones if these are few; sorted, without flags."""
        own = lambda flags, wanted: F.filter("codes", lambda c: c.bitwiseAND(F.lit(flags).cast("long")) == wanted)
        band, all_ = own(flag | RARER, flag), own(flag, flag)
        return F.array_sort(F.transform(F.when(F.size(band) < few, all_).otherwise(band), lambda c: c.bitwiseAND(_bits((1 << 64) - 1 - FLAGS))))

    docs_ = docs_.select("_to", "_n", "_copy", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("own_hash")).alias("own_hash"), F.lower(F.hex("edited_hash")).alias("edited_hash"), chosen(OWN).alias("own"), chosen(EDITED).alias("changed"))
    docs_ = hashed(hashed(docs_, "own", "own_hash", "fingerprint"), "changed", "edited_hash", "edited_fingerprint")
    docs_ = docs_.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("_to").orderBy("_n"))).where("_copy = 0")
    return docs_.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
