import random

import pytest

from actlake.llm import neardup
from actlake.llm.common import Workspace
from actlake.llm.components import components


def brute(rows, k, percent=80):
    sets, best = {}, {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        if d is not None:
            sets.setdefault(d, []).append(s)
    best = {d: d for d in sets}
    def root(x):
        while best[x] != x:
            x = best[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                best[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}, {d: sorted(len(s) for s in own) for d, own in sets.items()}


def check(docs, rows, k):
    want, sizes = brute(rows, k)
    got = neardup.near_duplicates(docs, words=k).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
        seen.setdefault(r["doc_id"], []).append(r["n_shingles"])
    assert all(sorted(seen[d]) == n for d, n in sizes.items())


def test_odd_documents(odd_docs, odd_rows, no_docs):
    check(odd_docs, odd_rows, 4)
    assert neardup.near_duplicates(no_docs).count() == 0


def edited(words, rnd, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"new{rnd.random()}"
    return " ".join(out)


@pytest.mark.parametrize("few", [2, 32])
def test_large_groups_against_brute_force(spark, monkeypatch, few):
    """Copies with few to many edits: some of the group are linked with its middle, some with each other only, some not at all."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = [(i * 7 % 211, edited(base, rnd, rnd.choice([0, 1, 3, 5, 7, 9]))) for i in range(120)]
    rows += [(1000 + i, " ".join(f"u{rnd.randrange(9000)}" for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(docs, rows, 4)


def test_components_of_a_path_and_a_star(spark):
    ws = Workspace(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(ws, links).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
