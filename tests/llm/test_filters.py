"""Quality rules, toxicity, language ID and licence scans."""

import random
import re

import pytest

from panelgrid.llm import langid, license_scan, quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def quality_texts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "and", "cat", "é🙂", "#", "x\n", "\n"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    return texts + [None, "", " \n\t ", "a b c a b c", "a a a a a", "x" * 5000, "one\ntwo\none\n\n\none"]


def test_figures_equal_brute_force(spark, monkeypatch):
    rows = list(enumerate(quality_texts()))
    for bits in (quality.PLACE_BITS, 4):  # with so few bits, longer texts are sorted as pairs
        monkeypatch.setattr(quality, "PLACE_BITS", bits)
        got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        for r in got:
            n, chars, symbols, dup, repeat = brute_figures(dict(rows)[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
            assert not (r.base_failed and r.kept)


def test_filter_keeps_rows_and_columns(spark):
    good = " ".join(f"the word{k} of thing{k}" for k in range(30))
    rows = [(1, good, "a", 5), (1, good, "a", 5), (None, good, None, None), (2, "#" * 100, "b", 1), (3, None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    assert sorted(quality.filter_quality(docs).collect(), key=str) == sorted((r for r in docs.collect() if r.text == good), key=str)
    assert quality.filter_quality(docs.limit(0)).count() == 0


def test_only_expressions_run(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.score_quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        bad = k // 2 % 8 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Scumbag!", "moron"])
        rows.append((k, " ".join(text)))
        if k % 2 == 0:
            labels.append((k, int(bad)))
    return (spark.createDataFrame([*rows, (None, "moron"), (2000, None)], "doc_id long, text string"),
            spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))


def test_toxicity(spark, insults):
    docs, labels = insults
    model = toxicity.learn(docs.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id IS NOT NULL"), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    unseen = [k for k in range(900) if k % 3 == 1]
    assert all((got[k] >= toxicity.THRESHOLD) == (k // 2 % 8 == 0) for k in unseen)
    assert got[2000] < toxicity.THRESHOLD
    left = toxicity.filter_toxic(docs.selectExpr("*", "'x' AS score", "'y' AS _row1"), model)
    assert left.columns == ["doc_id", "text", "score", "_row1"] and left.where("floor(doc_id / 2) % 8 = 0 AND doc_id < 900").count() == 0


def test_toxicity_without_examples(spark, insults):
    docs, labels = insults
    for d, m in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("toxic = 0"))):
        assert toxicity.score(docs, toxicity.learn(d, m)).agg({"score": "max"}).first()[0] < 1e-9


def test_risk_is_corrected_for_the_prior():
    """Among unlabelled rows a third have the feature; the examples all do."""
    import numpy as np

    positive = np.arange(400) < 100
    row = np.flatnonzero((np.arange(400) < 200))
    w, b = toxicity._fit((row, np.zeros(len(row), np.int64)), positive, 1, 1 / 3)
    assert w[0] + b > 1.5 and b < -1.5


LANGS = {"aa": "lorem dolor amet sit ipsum velit", "bb": "zwo drei vier fünf sechs sieben", "cc": "yksi kaksi kolme neljä viisi kuusi"}


def test_language(spark):
    rng = random.Random(8)
    make = lambda lang, n: " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", ",", "."]) for _ in range(n))
    rows = [(k, lang, make(lang, 30)) for k in range(120) for lang in [rng.choice(list(LANGS))]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    odd = [(1000, None, None), (1001, "aa", ""), (1002, "aa", "12 34 !!"), (None, None, make("bb", 9).upper()), (1004, None, make("cc", 60000))]
    model = langid.learn(docs.where("doc_id % 3 <> 1").unionAll(spark.createDataFrame(odd[:3], docs.schema)))
    assert {m[0] for m in model} == set(LANGS)
    got = langid.identify(docs.unionAll(spark.createDataFrame(odd, docs.schema)), model, keep=("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 1000)
    rest = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [rest[k] for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert rest[None][0] == "bb" and rest[1004][0] == "cc"
    assert langid.learn(docs.limit(0)) == []
    assert langid.identify(docs, []).where("lang_pred <> 'und' OR reliable").count() == 0


def test_letters_only():
    assert langid.letters_only(["Ab1 cD!é", None, "12", "", "x"]) == ["ab cd é".encode(), b"", b"", b"", b"x"]


def brute_scan(text, templates, least):
    """The best coefficient over all runs of segments."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))
    grams = lambda w: set(zip(w, w[1:], strict=False))
    segments = [s for s in re.split(r"(?<=[.!?;:])\s+|\n", text or "") if words(s)]
    out = {}
    for name, t in templates.items():
        want = grams(words(t))
        best = 0
        for a in range(len(segments)):
            for b in range(a + 1, len(segments) + 1):
                own = grams([x for s in segments[a:b] for x in words(s)])
                if own or want:
                    best = max(best, 2 * len(own & want) / (len(own) + len(want)))
        if want and best >= least:
            out[name] = round(best, 9)
    return out


def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rng = random.Random(3)
    texts = [None, "", "No licence here.", "Intro words here.\nReleased under the MIT license!\nMore text.", mit, mit.replace("software", "program", 1) + "\nand on it goes",
             "Released under the\nMIT License.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "x " * 30000 + ". Released under the MIT License."]
    vocabulary = " ".join(license_scan.TEMPLATES.values()).split()
    for _ in range(40):
        at = rng.randrange(len(vocabulary) - 30)
        texts.append("Some words. " + " ".join(w for w in vocabulary[at:at + rng.randint(5, 30)] if rng.random() < 0.95) + "\nand an end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' AS licenses", "1 AS n_chars")
    for r in license_scan.scan(docs).collect():
        assert {x.name: round(x.dice, 9) for x in r.licenses} == brute_scan(texts[r.doc_id], license_scan.TEMPLATES, license_scan.DICE)
        for x in r.licenses:
            assert texts[r.doc_id].encode()[x.start:x.end]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_features_are_counted_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 20)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 100)
    docs = [(k, f"plain words here{k % 7} " + (f"vile{'abcdefghijklmnopqrst'[k % 20]}" if k < 200 else "fine")) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame([(k, int(k < 200)) for k in range(400)], "doc_id long, toxic int"))
    wanted = {int(s) for c in "abcdefghijklmnopqrst" for s in toxicity.gram_slots([f"vile{c}".encode()])[0][:1]}
    assert wanted <= {f // len(toxicity.LEVELS) for f in model.features}  # each in 10 of 200 positives, in about one of the sample's 20
