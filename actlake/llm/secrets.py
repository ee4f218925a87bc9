"""Secret scans behind a trigram inverted index. Built-in functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The index
holds a posting (trigram, text) for each trigram that some rule asks for and each text that holds it, sorted by
trigram. A query is a union of clauses, and a clause an intersection of posting lists: clauses fetch the postings of
their trigrams by a join, and a text is a candidate where all of a clause's trigrams have met. Only candidates run the
rule's expression; a rule without mandatory trigrams scans every text.

A text is known by its hash, so copies share their postings, and two texts that share a hash by chance are candidates
of each other's rules, which costs an expression but changes nothing. Posting lists are never gathered into a row: a
trigram of any frequency is spread out by the hashes of its texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import Workspace, ascii_lower, hot_keys, packed, spread_join, unpacked

#: Strings that a part of an expression may stand for while they are still listed, and characters of a class.
STRINGS, CLASS = 64, 4
#: Trigrams of a clause, and clauses of a rule; a query that has more is weakened, so that it stays true of all matches.
GRAMS, CLAUSES = 62, 256
#: Texts that are candidates of some rule are broadcast up to this many (16 bytes and their rules each), joined by a shuffle beyond.
BROADCAST_TEXTS = 500_000

#: A query is True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    """pattern: valid in Java and Python alike; lengths: least code points of group `group`, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's base rules, then the method's own; spans that start together are in this order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more is a maximal match of [0-9a-f]+ that isn't dropped, and the other way round.
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,order:int,end:int,kind:string>"


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    flat = {p: {p} if isinstance(p, str) else set(p[1:]) for p in parts if p is not True and p[0] != "or"}
    parts = [p for p in parts if p not in flat or not any(q != p and own < flat[p] for q, own in flat.items())]  # A or (A and B) is A
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    """What a text with one of the strings must hold; case is folded, as in the index."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted({x.lower() for x in strings})])


def trigram_query(pattern: str) -> Query:
    """A condition on the trigrams of the lower-cased text that every match of the pattern meets.

    Walks the parsed expression: where a part stands for a few strings only, they are multiplied with what stands
    before; elsewhere the strings so far become a condition and a new run of strings starts.
    """

    def walk(nodes) -> tuple[set[str] | None, Query]:
        """Either the strings that the nodes stand for, or a condition."""
        run: set[str] = {""}
        conditions: list[Query] = []

        def close() -> None:
            nonlocal run
            conditions.append(_of_strings(run))
            run = {""}

        exact = True
        for kind, value in nodes:
            strings, condition = one(kind, value)
            if strings is None:
                close()
                conditions.append(condition)
                exact = False
            elif len(run) * len(strings) > STRINGS:
                close()
                run, exact = set(strings), False
            else:
                run = {a + b for a, b in product(run, strings)}
        if exact:
            return run, True
        close()
        return None, _all(conditions)

    def one(kind, value) -> tuple[set[str] | None, Query]:
        if kind is op.LITERAL:
            return {chr(value)}, True
        if kind is op.IN:
            found: set[str] = set()
            for k, v in value:
                if k is op.LITERAL:
                    found.add(chr(v))
                elif k is op.RANGE and v[1] - v[0] < CLASS:
                    found |= {chr(c) for c in range(v[0], v[1] + 1)}
                else:
                    return None, True
            return (found, True) if len(found) <= 2 * CLASS else (None, True)
        if kind is op.SUBPATTERN:
            return walk(value[-1])
        if kind is op.BRANCH:
            parts = [walk(x) for x in value[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= STRINGS:
                return set().union(*(s for s, _ in parts)), True
            return None, _any([c if s is None else _of_strings(s) for s, c in parts])
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            strings, condition = walk(inner)
            if strings is not None and (least, most) == (0, 1):
                return strings | {""}, True
            if least == 0:
                return None, True
            return None, condition if strings is None else _of_strings(strings)
        if kind is op.AT:
            return {""}, True
        return None, True

    strings, condition = walk(parser.parse(pattern))
    return condition if strings is None else _of_strings(strings)


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def clauses(query: Query) -> list[tuple[str, ...]]:
    """The query as a union of intersections; empty for True. A union or intersection too large loses conditions, never matches."""
    if query is True:
        return []
    if isinstance(query, str):
        return [(query,)]
    parts = [clauses(p) for p in query[1:]]
    if query[0] == "or":
        return [] if any(not p for p in parts) or sum(map(len, parts)) > CLAUSES else list(dict.fromkeys(c for p in parts for c in p))
    out: list[tuple[str, ...]] = [()]
    for p in sorted(filter(None, parts), key=len):
        if len(out) * len(p) <= CLAUSES:
            out = list(dict.fromkeys(tuple(dict.fromkeys(x + y))[:GRAMS] for x, y in product(out, p)))
    return [c for c in out if c] if all(out) else []


class TrigramIndex:
    """Postings of the trigrams that some rule asks for, and the queries over them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.clauses = {i: clauses(trigram_query(r.pattern)) for i, r in enumerate(rules)}
        self.grams = sorted({g for own in self.clauses.values() for c in own for g in c})

    def postings(self, texts: DataFrame) -> DataFrame:
        """gram, key of each wanted trigram and each of the texts (_key, _text) that hold it. Other than ASCII letters are indexed as they are.

        One pass over a text finds the trigrams at all places, overlapping ones too.
        """
        heads: dict[str, list[str]] = {}
        for g in self.grams:
            heads.setdefault(g[0], []).append(re.escape(g[1:]))
        wanted = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in heads.items())
        found = F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(f"(?=({wanted}))"), F.lit(1))
        return texts.select(F.explode(F.array_distinct(found)).alias("gram"), F.col("_key").alias("key"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """key and _rules (numbers of the rules whose query the text satisfies).

        A clause's trigrams are bits, so that a posting that is met twice, by copies of a text, counts once.
        """
        spark = postings.sparkSession
        asked = [(g, i, j, 1 << at, (1 << len(c)) - 1) for i, own in self.clauses.items() for j, c in enumerate(own) for at, g in enumerate(c)]
        asked = F.broadcast(spark.createDataFrame(asked, "gram string, rule int, clause int, bit long, wanted long"))  # as many rows as the rules have trigrams
        met = postings.join(asked, "gram").groupBy("key", "rule", "clause", "wanted").agg(F.bit_or("bit").alias("met")).where("met = wanted")
        return met.groupBy("key").agg(F.collect_set("rule").alias("_rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """start, order, end, kind of the rule's matches that are kept, by start; in code points, end exclusive.

    The stretches between the matches and the matches themselves come from the same left-to-right search, so their
    lengths add up to the offsets.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length), F.transform(found, F.length), F.transform(checked, F.length))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["0"]
        end = begin + F.coalesce(part["1"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = F.coalesce(part["2"], F.lit(0)) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["own"], F.array(span))).otherwise(acc["own"]).alias("own"))

    # Stretches of the square root of the number of matches: an array that grows by one match is short.
    def stretch(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("own")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["all"], F.array(r["own"])).alias("all")))[0]

    wide = F.ceil(F.sqrt(F.size(parts))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / wide).cast("int")), lambda i: F.slice(parts, i * wide + 1, wide))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("all"))
    return F.aggregate(cut, start, stretch, lambda acc: F.flatten(acc["all"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds spans_col: array of (start, order, end, kind) of the secrets in each whole text, by start, then rule order.

    Offsets count code points, ends are exclusive. Matches of a rule are leftmost and don't overlap; rules are
    independent of each other. Null and empty texts have none. Rows are neither merged nor dropped, repeated ones
    included. Other columns pass through, whatever they are called; one already named spans_col is replaced. An empty
    table gives an empty result.
    """
    index, ws = TrigramIndex(rules), Workspace(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = packed(docs, _text=text, _key=F.xxhash64(text))
    known = F.lit(None).cast("array<int>")
    if index.grams:
        postings = ws.save(index.postings(rows).sortWithinPartitions("gram"))
        found = ws.save(index.candidates(postings))
        if found.count() <= BROADCAST_TEXTS:
            rows = rows.join(F.broadcast(found.withColumnRenamed("key", "_key")), "_key", "left")
        else:
            hot = hot_keys(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), ["_key"])
            spread = rows.withColumn("_at", F.xxhash64("_row"))
            rows = spread_join(spread, found.withColumnRenamed("key", "_key"), ["_key"], hot, ["_at"], "left")
        known = F.col("_rules")
    none, subject = F.array().cast(f"array<{SPAN}>"), F.col("_text")
    asks = lambda i: F.coalesce(F.array_contains(known, i), F.lit(False)) if index.clauses[i] else F.lit(True)
    spans = [F.when(asks(i) & F.regexp_like(subject, F.lit(r.pattern)), _spans(subject, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return unpacked(rows, docs.columns, **{spans_col: F.array_sort(F.concat(*spans))})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (all, as kind:start:end) of each row of documents."""
    found = scan(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("text")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
