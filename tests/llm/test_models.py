"""Language, quality and toxicity: held-out accuracy on made-up texts, and what every operator must bear."""

import random

import pytest
from fixtures import DOC_SCHEMA, doc, odd_rows

from millrace.llm import language, quality, toxicity

SYLLABLES = {"en": ["th", "ing", "er", "and", "ou"], "fr": ["eau", "é", "tion", "oi", "que"], "de": ["sch", "ung", "ie", "ü", "ch"]}


def made(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    return [(i, made(rng, lang, rng.randrange(5, 80)), lang) for i, lang in ((i, rng.choice(list(SYLLABLES))) for i in range(600))]


def frame(spark, rows):
    return spark.createDataFrame([doc(i, t, lang) for i, t, lang in rows], DOC_SCHEMA)


def test_language(spark, corpus):
    model = language.fit(frame(spark, corpus[:400]))
    got = {r["doc_id"]: r for r in language.identify(frame(spark, corpus[400:]), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in corpus[400:]) >= 196
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_draws_are_bounded_and_do(spark, corpus):
    model = language.fit(frame(spark, corpus[:400]), train_rows=30)
    got = language.identify(frame(spark, corpus[400:]), model).collect()
    assert sum(r["lang_pred"] == corpus[r["doc_id"]][2] for r in got) >= 190


def test_language_odd_rows(spark, corpus):
    model = language.fit(frame(spark, corpus[:100]))
    rows = odd_rows() + [doc(1, "12 345 !!"), doc(2, None, None)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumnRenamed("source", "lang_pred")
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 900, 901, 902):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == (language.UNKNOWN, 0.0)
    assert by_id[904]["lang_pred"] in SYLLABLES


def test_language_without_training(spark, corpus):
    model = language.fit(frame(spark, corpus).where("doc_id < 0"))
    assert {r["lang_pred"] for r in language.identify(frame(spark, corpus[:5]), model).collect()} == {"und"}
    assert language.identify(frame(spark, corpus).where("doc_id < 0"), language.fit(frame(spark, corpus))).count() == 0


def labelled(spark, rows, name, value):
    return spark.createDataFrame([(i, value(t)) for i, t, _ in rows], f"doc_id long, {name} int")


def test_quality(spark, corpus):
    rng = random.Random(9)
    rows = [(i, " ".join(w + "***" for w in t.split()) if rng.random() < 0.3 else t, lang) for i, t, lang in corpus]
    labels = labelled(spark, rows[:400], "quality", lambda t: int("***" not in t))
    model = quality.fit(frame(spark, rows), labels)
    got = quality.grade(frame(spark, rows[400:]), model).collect()
    assert sum((r["score"] >= 0.5) == ("***" not in rows[r["doc_id"]][1]) for r in got) >= 195


def test_quality_odd_rows(spark, corpus):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (903, 1)], "doc_id long, quality int")
    rows = odd_rows() + [doc(1, "good words"), doc(2, "bad")]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    model = quality.fit(docs, labels)
    got = quality.grade(docs.withColumnRenamed("source", "score"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in quality.grade(docs, none).collect()} == {0.5}
    assert quality.grade(docs.where("doc_id < 0"), none).count() == 0


def test_toxicity(spark, corpus):
    rng = random.Random(10)
    bad = ["scumwort", "idiotik", "trashen"]
    rows = [(i, f"{t} {rng.choice(bad)} {made(rng, lang, 10)}" if rng.random() < 0.2 else t, lang) for i, t, lang in corpus]
    toxic = lambda t: int(any(b in t for b in bad))
    labels = labelled(spark, rows[:400], "toxic", toxic)
    model = toxicity.fit(frame(spark, rows), frame(spark, rows[:400]), labels)
    got = toxicity.score(frame(spark, rows[400:]), model).collect()
    assert sum((r["score"] >= 0.5) == bool(toxic(rows[r["doc_id"]][1])) for r in got) >= 196
    kept = toxicity.without_toxic(frame(spark, rows[400:]).withColumnRenamed("source", "toxicity"), model)
    assert "toxicity" in kept.columns and kept.count() >= 140


def test_toxicity_odd_rows(spark):
    rows = odd_rows() + [doc(1, "bad bad"), doc(2, "fine")]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs, docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.where("doc_id < 0"), toxicity.fit(docs.limit(0), docs.limit(0), labels.limit(0))).count() == 0
    again = toxicity.score(toxicity.score(docs, model), model)
    assert again.columns == [*docs.columns, "score"] and again.count() == len(rows)
