"""URL filter rules, indexed by their rarest literal token. Built-in functions only.

Every rule is a regular expression over `host + path` (host lower-cased) with the literal tokens that a matching
URL must hold. The index keeps each rule under the one of its tokens that the fewest URLs have. The tokens of a URL
fetch its candidate rules through a join on the token; regular expressions run on candidates alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlake.llm.common import ascii_lower, hot_keys, spread_join

#: Rules are broadcast up to this many; beyond it Spark joins them by shuffling.
BROADCAST_RULES = 20_000
TOKEN_BREAK = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """text: as reported; verdict: allow or block; pattern: Java regex over host + path; tokens: literals that a match holds whole; listed: it is a host/path rule, which beats all pattern rules."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains where the URL's path starts with path."""
    # The path may end within one of the URL's tokens; only tokens followed by a break are sure.
    sure = [t for t in re.split(TOKEN_BREAK, host)] + re.split(TOKEN_BREAK, path)[:-1]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(t for t in sure if t), True)


def token_rule(verdict: str, *words: str) -> Rule:
    """Fits where the words stand next to each other, parted by one character that isn't a letter or digit."""
    inner = "[^a-z0-9]".join(map(re.escape, words))
    return Rule(" ".join(words), verdict, rf"(?:^|[^a-z0-9]){inner}(?:[^a-z0-9]|$)", tuple(words))


def filter_rule(line: str) -> Rule | None:
    """A rule from a line of a filter list, matched against the lower-cased host + path.

    `*` stands for any characters, `^` for the end or one character other than letters, digits and `_.%-`, `|` at either
    end for the start or end, `||` in front for the start of the host or of one of its labels; `@@` in front allows.
    Blank lines, comments (`!`, `#`, `[`) and a list's options (from `$` on) are left out.
    """
    line = line.strip()
    verdict, body = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    body = body.split("$", 1)[0].lower()
    if not body.strip("*|^") or body[0] in "!#[":
        return None
    start = r"^(?:[^/]*\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
    end = "$" if body.endswith("|") else ""
    inner = body.strip("|")
    parts = re.split(r"([*^])", inner)
    pattern = start + "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(x, re.escape(x)) for x in parts) + end
    # A token is sure where a break, or a fixed border, stands on both of its sides.
    sure = []
    for m in re.finditer("[a-z0-9]+", inner):
        left = inner[m.start() - 1] if m.start() else "^" if start else "*"
        right = inner[m.end()] if m.end() < len(inner) else "^" if end else "*"
        if left != "*" and right != "*":
            sure.append(m.group())
    return Rule(line, verdict, pattern, tuple(sure))


def load_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of filter lists: text files with a rule a line, each text once."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").distinct().orderBy("v").collect()  # a list that people keep
    return tuple(rule for r in lines if (rule := filter_rule(r["v"])))


#: The contract's host rules.
HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: The method's own rules, for URLs that no host rule fits.
PATTERN_RULES = tuple(
    token_rule("block", *words)
    for words in (("spam", "farm"), ("cheap", "pills"), ("casino",), ("viagra",), ("porn",), ("xxx",), ("adult",), ("payday", "loans"), ("free", "download"), ("click", "track"), ("ads", "track"), ("adserver",), ("torrent",))
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased; path up to ? or #. Both empty where url is null or has no ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(url, parts, i), F.lit(""))
    return ascii_lower(get(1)), get(2)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, url_col: str = "url", key_cols: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """key_cols, host, path, rule (the longest host rule that fits, ties to the smaller text; else null), verdict, pattern.

    Where no host rule fits, the verdict is block if a blocking pattern rule fits and no allowing one does (`pattern`
    names the smallest that decides), else allow. Rules without a sure token are tried on every distinct URL. Distinct
    URLs are judged once, so repeated URLs and rows cost one judgement; rows with a null url have empty host and path
    and are allowed. Rows aren't dropped or merged; an empty table gives an empty result. Other columns don't matter.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*key_cols, host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(F.array_union(F.split(ascii_lower(F.concat("host", "path")), TOKEN_BREAK), F.array(F.lit("")))).alias("token"))

    listed = spark.createDataFrame([(i, r.text, r.verdict, r.pattern, r.listed, list(r.tokens)) for i, r in enumerate(rules)], "rule_no int, text string, rule_verdict string, pattern string, listed boolean, tokens array<string>")
    # A rule without tokens is kept under the empty one, which every URL has.
    wanted = listed.select("rule_no", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    bounded = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    # How many URLs hold each token of a rule: counted over all of them, partial sums before the shuffle.
    counts = tokens.join(bounded(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = wanted.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    index = listed.join(index, "rule_no").select(F.col("rarest.token").alias("token"), "text", "rule_verdict", "pattern", "listed")

    # Case matters in the path of host rules; pattern rules see it lower-cased.
    subject = F.concat("host", "path")
    hits = tokens.join(bounded(index), "token").where(F.when(F.col("listed"), F.regexp_like(subject, F.col("pattern"))).otherwise(F.regexp_like(ascii_lower(subject), F.col("pattern"))))
    best = hits.groupBy("host", "path").agg(
        F.min(F.when(F.col("listed"), F.struct((-F.length("text")).alias("len"), "text", "rule_verdict"))).alias("host_hit"),
        F.min(F.when(~F.col("listed"), F.struct("rule_verdict", "text"))).alias("pattern_hit"),  # allow comes before block
    )
    # A URL that very many rows have is dealt to several tasks.
    shared = hot_keys(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), ["host", "path"])
    return spread_join(rows, best, ["host", "path"], shared, list(key_cols), "left").select(
        *key_cols,
        "host",
        "path",
        F.col("host_hit.text").alias("rule"),
        F.coalesce("host_hit.rule_verdict", "pattern_hit.rule_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("host_hit").isNull(), F.col("pattern_hit.text")).alias("pattern"),
    )


def _oracle() -> str:
    fits = "\n".join(f"UNION ALL SELECT host, path, '{h}{p}' AS rule, '{v}' AS verdict FROM urls WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")))
    words = "UNION ALL ".join(f"SELECT host, path, '{r.text}' AS pattern FROM urls WHERE regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{r.pattern}')\n" for r in PATTERN_RULES)
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
urls AS (SELECT DISTINCT host, path FROM p),
fits AS ({fits.removeprefix("UNION ALL ")}),
longest AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) = 1),
words AS ({words}),
word AS (SELECT host, path, min(pattern) AS pattern FROM words GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN longest USING (host, path) LEFT JOIN word USING (host, path)
"""


ORACLE_SQL = _oracle()
