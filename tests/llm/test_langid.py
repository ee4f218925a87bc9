import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.llm import langid
from actlake.llm.common import held_out


def greedy(codes, reference):
    """Phrases of a parse from the first code to the last: longest matches, codes that the reference lacks alone."""
    j, n = 0, 0
    while j < len(codes):
        m = 1
        while j + m < len(codes) and codes[j : j + m + 1] in reference:
            m += 1
        j, n = j + m, n + 1
    return n


def as_string(parser, text):
    return "".join(chr(0x100 + int(c)) for c in parser.code[langid._points(text)])


@pytest.mark.parametrize("dense", [0, 62])
@pytest.mark.parametrize("segment", [1, 7, 256])
def test_whole_texts_against_greedy_parsing(monkeypatch, dense, segment):
    """Exactly, phrases across the cuts of the stretches included."""
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(7)
    refs = (("a", "the cat sat on the mat and the dog ran " * 3 + "a" * 400), ("b", "der hund lief und die katze sass " * 9), ("c", "".join(rng.choice(list("漢字仮名 "), 600))))
    parser = langid.CrossParser(refs)
    texts = ["The cat and the hund ran!", "ß", "x" * 300, "", "sass der hund auf der mat, und lief 12 mal", "a" * 1500, ("the cat sat on the mat and the dog ran " * 40)[5:]]
    texts += ["".join(rng.choice(list("the catdog hunlifr漢字?"), n)) for n in (255, 256, 257, 3000)]
    found, sizes, letters = parser.phrases(texts)
    for k, (_, ref) in enumerate(refs):
        own = as_string(parser, ref)
        assert found[:, k].tolist() == [greedy(as_string(parser, t), own) for t in texts]
    assert sizes.tolist() == [len(t) for t in texts] and letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_eight_scripts(spark):
    """Letters of scripts of many sizes; each language is told from the others, by more than 0.95 of its held-out rows."""
    rng = np.random.default_rng(9)
    scripts = {"en": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x628, 35), "he": (0x5D0, 27), "th": (0xE01, 46), "ja": (0x3041, 80), "zh": (0x4E00, 900), "ko": (0xAC00, 500)}
    rows, i = [], 0
    for lang, (start, n) in scripts.items():
        letters = [chr(start + j) for j in range(n) if chr(start + j).isalpha()]
        words = ["".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(300)]
        for _ in range(60):
            rows.append((i, " ".join(rng.choice(words, 15)), lang))
            i += 1
    df = spark.createDataFrame([(int(a), str(b), str(c)) for a, b, c in rows], "doc_id long, text string, lang string")
    out = langid.identify(df, langid.learn(df)).where(held_out(df["doc_id"])).collect()
    for lang in scripts:
        own = [r["lang_pred"] == lang for r in out if r["lang"] == lang]
        assert len(own) > 5 and np.mean(own) > 0.95


def test_sample_bounds_and_repeated_rows(spark):
    rows = [(i, f"text number {i} " + "abc " * 50, "en") for i in range(50)] + [(900, "one text again and again", "de")] * 40 + [(901, "rare words", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = dict(langid.learn(df, rows=5, chars=500, languages=2))
    assert set(refs) == {"en", "de"} and refs["de"].count("again and again") == 1 and len(refs["en"]) <= 500
    clash = langid.identify(df.withColumn("_found", F.lit(1)).withColumn("score", F.lit("x")), langid.learn(df))
    assert clash.columns == ["doc_id", "text", "lang", "_found", "score", "lang_pred"] and clash.first()["_found"] == 1


def test_automaton_accepts_substrings_only():
    codes = [1, 2, 1, 3, 1, 2, 2]
    table = langid.suffix_automaton(codes, 5)
    subs = {tuple(codes[i:j]) for i in range(7) for j in range(i + 1, 8)}
    rng = np.random.default_rng(0)
    for _ in range(500):
        word, state = tuple(rng.integers(1, 4, rng.integers(1, 6)).tolist()), 0
        for c in word:
            state = int(table[state, c])
            if not state:
                break
        assert bool(state) == (word in subs)


def test_held_out_accuracy_and_odd_rows(spark, odd_docs, odd_rows, no_docs):
    words = {"en": ["the", "house", "with", "thing", "ought"], "de": ["der", "haus", "mit", "ung", "schön"], "fr": ["le", "maison", "avec", "eau", "été"]}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(rng.choice(list(words), 300))]
    df = spark.createDataFrame([(int(a), str(b), str(c)) for a, b, c in rows], "doc_id long, text string, lang string")
    refs = langid.learn(df)
    out = langid.identify(df, refs).where(held_out(df["doc_id"])).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98 and all(0 <= r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd_docs, refs).collect()}
    assert all(odd[d] == ("und", 0.0) for d in (6, 7, 8)) and odd[1][0] == "en"
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.learn(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, refs).count() == 0 and langid.identify(odd_docs, langid.learn(odd_docs)).count() == len(odd_rows)


def test_letters_of_small_scripts_stay_apart(spark):
    """Two languages whose letters come after 80 more frequent ones of another."""
    rng = np.random.default_rng(2)
    words = {"big": [chr(0x100 + i) * 2 for i in range(80) if chr(0x100 + i).isalpha()] + [chr(0x430 + i) * 2 for i in range(32)]}
    for lang, start in (("ja", 0x3041), ("ko", 0xAC00), ("zh", 0x4E00)):
        words[lang] = [chr(start + i) + chr(start + 40 + (i * 7) % 40) for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[lang], 60 if lang == "big" else 6)), lang) for i, lang in enumerate(["big"] * 120 + ["ja", "ko", "zh"] * 40)]
    df = spark.createDataFrame([(int(a), str(b), str(c)) for a, b, c in rows], "doc_id long, text string, lang string")
    out = langid.identify(df, langid.learn(df)).where(held_out(df["doc_id"])).collect()
    assert len(out) > 50 and all(r["lang_pred"] == r["lang"] for r in out)


def test_sparse_automata_parse_alike(monkeypatch):
    rng = np.random.default_rng(3)
    refs = tuple((name, "".join(rng.choice(list(letters), 3000))) for name, letters in (("a", "abcdefgh ij"), ("b", "fghijklm nop"), ("c", "漢字仮名交 文漢")))
    texts = ["".join(rng.choice(list("abcfghkm 漢字仮Ωx."), n)) for n in (0, 1, 255, 256, 257, 2000)]
    dense = langid.CrossParser(refs).phrases(texts)[0]
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (langid.CrossParser(refs).phrases(texts)[0] == dense).all() and dense[1:].min() > 0
