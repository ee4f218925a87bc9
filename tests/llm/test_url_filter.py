import re

from pyspark.sql import functions as F

from actlake.llm import url_filter as uf

URLS = [
    "http://a.example.com/en/1?x#y", "https://WWW.Example.COM/en/2", "http://example.com/EN/3", "http://notexample.com/en/4", "http://x.net/es/5", "http://x.net/fr", "http://net/fr/6", "ftp://com", "http://com/",
    "no scheme.com/en/", None, "", "http://spam-farm.example.org/en/7", "http://spamfarm.org/", "a://b://com/en/", "http://h.org/path/cheap_pills/x", "http://h.org:80/?casino", "http://h.org/casino", "http:///es/", "http://sub.www.example.com/en/x\ny",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, *best
    low = (host + path).encode().lower().decode()
    hit = any(re.search(r.pattern, low) for r in uf.PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def test_against_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("extra")).withColumn("verdict", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:5] for r in uf.judge(pages).collect()}
    assert got == {i: brute(u) for i, u, _ in rows}
    assert uf.judge(pages.limit(0)).count() == 0


def test_rules_are_indexed_by_their_rarest_token():
    rule = uf.host_rule("block", "example.com", "/en/pa")
    assert rule.tokens == ("example", "com", "en")


LINES = """! a comment
||ads.example.org^
||tracker.
|plain.host/start
/banner/*/img^
swf|
@@||good.ads.example.org^
-popup-$third-party
*
||shop.example/*?x
"""
TRIED = ["http://ads.example.org/", "http://x.ads.example.org", "http://myads.example.org/", "http://good.ads.example.org/a", "http://tracker.io/x", "http://a.tracker.net/", "http://plain.host/start/x", "http://my.plain.host/start", "http://h/banner/1/2/img", "http://h/banner/1/imgs", "http://h/a.swf", "http://h/a.swf/b", "http://h/x-popup-y", "http://h/xpopupy", "http://swf/", "http://h/A-POPUP-b", "http://shop.example/a?x"]


def fits(line, subject):
    """A filter line by a hand-written matcher."""
    body = line.removeprefix("@@").split("$")[0].lower()
    labels = body.startswith("||")
    fixed, ends, inner = body.startswith("|"), body.endswith("|"), body.strip("|")

    def at(i, j):
        if i == len(inner):
            return not ends or j == len(subject)
        c = inner[i]
        if c == "*":
            return any(at(i + 1, k) for k in range(j, len(subject) + 1))
        if c == "^":
            return (j == len(subject) and at(i + 1, j)) or (j < len(subject) and not re.match("[a-z0-9_.%-]", subject[j]) and at(i + 1, j + 1))
        return j < len(subject) and subject[j] == c and at(i + 1, j + 1)

    host = len(subject.split("/")[0])
    starts = [0] + [k for k in range(1, host) if subject[k - 1] == "."] if labels else [0] if fixed else range(len(subject) + 1)
    return any(at(0, j) for j in starts)


def test_filter_lists_against_brute_force(spark, tmp_path, monkeypatch):
    (tmp_path / "list.txt").write_text(LINES)
    rules = uf.load_rules(spark, f"file://{tmp_path}/list.txt")
    assert len(rules) == 8
    pages = spark.createDataFrame(list(enumerate(TRIED)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in uf.judge(pages, rules).collect()}
    for i, url in enumerate(TRIED):
        host, path = brute(url)[:2]
        hit = sorted((r.verdict, r.text) for r in rules if fits(r.text, (host + path).lower()))
        assert got[i] == (hit[0] if hit else ("allow", None)), url
    assert {v for v, _ in got.values()} == {"allow", "block"}


def test_one_url_of_very_many_rows(spark, monkeypatch):
    from actlake.operators import spread

    monkeypatch.setattr(spread, "HOT_ROWS", 20)
    pages = spark.createDataFrame([(i, "http://x.net/es/5" if i % 3 else f"http://casino/{i}") for i in range(300)] + [(None, None)] * 30, "page_id long, url string")
    got = uf.judge(pages).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 300, "allow": 30}
