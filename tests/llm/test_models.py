import random

import numpy as np

from molloom.llm import language_id as li
from molloom.llm import quality_compression as qc

from .data import CASES, frame

SYLLABLES = {"en": ["th", "the", "ing", "and", "ly"], "fr": ["eau", "oi", "que", "é", "les"], "de": ["sch", "ung", "ü", "der", "keit"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def labelled(spark, n=120, seed=1):
    r = random.Random(seed)
    rows = [(i, text(r, lang := r.choice(list(SYLLABLES)), r.randint(20, 200)), lang) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark):
    rows, df = labelled(spark)
    model = li.train(df.where(li.fold("doc_id", 3) != 1))
    assert model[0] == ["de", "en", "fr"]
    got = {x.doc_id: x for x in li.predict(df.selectExpr("*", "1 AS SCORE"), model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)
    odd = {x.doc_id: x for x in li.predict(frame(spark, CASES), model).collect()}
    for i, t in enumerate(CASES):
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), repr(t)
        assert 0 <= odd[i].score <= 1


def test_mixtures():
    r = random.Random(5)
    corpus = {lang: text(r, lang, 3000) for lang in SYLLABLES}
    counts = np.array([np.bincount(li.trigrams(np.frombuffer(t.encode(), np.uint8)), minlength=1 << li.BITS) for t in corpus.values()])
    logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * (1 << li.BITS)))
    raw = (text(r, "en", 300) + " " + text(r, "de", 100)).encode()
    doc, bucket, count = li.bags(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    share, _ = li.mixtures(doc, np.exp(logs.T[bucket] - logs.T[bucket].max(1, keepdims=True)), count, 1)
    assert share[0].argmax() == 0 and 0.1 < share[0][2] < 0.45 and share[0][1] < 0.1
    pred, score = li.infer(np.array([0, len(raw), len(raw)]), np.frombuffer(raw, np.uint8), logs)
    assert pred.tolist() == [0, -1] and 0.4 < score[0] < 0.95


def test_languages_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "abc def", None)], "doc_id long, text string, lang string")
    model = li.train(df)
    assert model[0] == [] and {r.lang_pred for r in li.predict(df, model).collect()} == {"und"}
    assert li.predict(df.limit(0), model).count() == 0


def test_quality(spark):
    r = random.Random(2)
    junk = lambda n: " ".join("".join(r.choice("xqzjk") for _ in range(r.randint(1, 9))) + r.choice("!$%&") * 3 for _ in range(n))
    rows = [(i, junk(r.randint(20, 120)) if (bad := i % 4 == 0) else text(r, "en", r.randint(20, 120)), int(not bad)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = li.fold("doc_id", 4) == 2
    model = qc.train(df.where(~held))
    got = {x.doc_id: x.score for x in qc.score(df.where(held).selectExpr("*", "1 AS SCORE"), model).collect()}
    assert got and all((got[i] >= 0.7) == bool(q) for i, _, q in rows if i in got)
    odd = {x.doc_id: x.score for x in qc.score(frame(spark, CASES), model).collect()}
    assert len(odd) == len(CASES) and all(0 <= s <= 1 for s in odd.values()) and odd[0] == odd[1] == model["share"]


def test_quality_of_one_label_or_none(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "c", None)], "doc_id long, text string, quality int")
    assert {r.score for r in qc.score(df, qc.train(df)).collect()} == {1.0}
    assert {r.score for r in qc.score(df, qc.train(df.limit(0))).collect()} == {0.5}
