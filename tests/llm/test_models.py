import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import crf, langid, queries, toxicity

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("span", [64, 3, 2, 1])
def test_forward_backward_matches_enumeration(span):
    """Whole sequences, in one piece or in many."""
    rng = np.random.default_rng(0)
    lens = np.array([1, 4, 3, 7, 2])
    score, moves, starts = rng.normal(size=(lens.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = crf.forward_backward(np.exp(score), lens, moves, starts, True, span)
    want, seen, at = np.zeros_like(score), np.zeros((3, 3)), 0
    for n in lens:
        total, part, step = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(starts[path[0]] + sum(score[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for t, y in enumerate(path):
                part[t, y] += p
            for a, b in itertools.pairwise(path):
                step[a, b] += p
        want[at : at + n] = part / total
        seen += step / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def test_spans():
    assert crf.spans(np.array([0, 3, 8, 9, 0]), 4).tolist() == [3, 4, 4, 4, 4, 1]


def test_code_switching():
    """A text that switches its language is labelled on both sides of the switch."""
    texts = [["das", "und", "nicht", "ist"] * 4, ["the", "and", "not", "is"] * 4] * 10
    tags = [np.full(16, i % 2) for i in range(20)]
    model = crf.train(texts, tags, ["de", "en"])
    m = crf.Tagger(model).marginals([["das", "ist", "und", "nicht", "the", "and", "is", "not"]])[0]
    assert (m[:4, 0] > 0.5).all() and (m[4:, 1] > 0.5).all()


def test_long_words():
    """The middle of a long word is read too."""
    a, b = crf.features("x" * 40 + "mid" + "x" * 40), crf.features("x" * 40 + "dim" + "x" * 40)
    assert sorted(a[-40:]) != sorted(b[-40:]) and len(set(a) ^ set(b)) > 6


def test_langid_held_out(spark):
    out = queries.op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok"), F.min("score"), F.max("score")).first()
    print(r)
    assert r["n"] > 1500 and r["ok"] > 0.98 and 0 <= r[2] <= r[3] <= 1


def test_letters():
    assert langid.words("a½b ²é Ⅷx x٢y d_e ①") == ["a", "b", "é", "x", "x", "y", "d", "e"] and langid.words(None) == langid.words("½ ² 12") == []


def test_langid_odd_rows(spark):
    docs = spark.createDataFrame([(1, "das und nicht", "de"), (2, "the and not", "en"), (3, None, "de"), (4, "½ ² 12 !? Ⅷ ①", "en"), (None, "das", None), (6, "", None), (7, "das " * 30000, None), (2, "the and not", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    got = [(r[0], r[1]) for r in langid.predict(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und"), (None, "de"), (6, "und"), (7, "de")], key=str)
    assert langid.fit(docs.limit(0), F.lit(True)) is None
    assert [r[1] for r in langid.predict(docs.limit(1), None).collect()] == ["und"]
    assert langid.predict(docs.limit(0), model).count() == 0


def test_langid_every_label(spark):
    """Each of many labels is learned, the rarest too."""
    names = [f"l{i:02d}" for i in range(70)]
    word = lambda i: chr(97 + i % 26) * 3 + chr(97 + i // 26) * 4
    rows = [(100 * i + k, " ".join([word(i)] * 20), y) for i, y in enumerate(names) for k in range(2 if i else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.fit(docs, F.lit(True))
    assert model.labels == names
    assert {(r[0], r[1]) for r in langid.predict(docs, model).collect()} == {(i, y) for i, _, y in rows}


def test_toxicity_held_out(spark):
    out = queries.op9_toxicity(spark, DATA)
    both = out.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "score", "predicted").toPandas()
    true = ((both.toxic == 1) & (both.predicted == 1)).sum()
    print(len(both), true, both.predicted.sum(), both.toxic.sum())
    # about one in twenty toxic labels here is of a document without a toxic word
    assert true / both.predicted.sum() > 0.97 and true / both.toxic.sum() > 0.8
    text = out.filter("predicted = 1").join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").select("text", "spans").first()
    assert text[1] and all(0 <= s["start"] < s["end"] <= len(text[0]) and text[0][s["start"] : s["end"]].isalnum() for s in text[1])


def test_toxicity_small_table(spark):
    """A few dozen labels are enough."""
    d = "/root/testdata/sf0.01"
    both = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("toxic", "predicted").toPandas()
    assert ((both.toxic == 1) == (both.predicted == 1)).mean() > 0.95


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, "ok fine text" if i % 3 else f"ok vile{i} text") for i in range(90)] + [(None, "vile text"), (200, None), (201, ""), (202, "İİ vile1 é"), (203, "ok " * 30000 + "vile7")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (3, 0), (500, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [got[i]["predicted"] for i in (None, 200, 201, 202, 203, 0, 1)] == [1, 0, 0, 1, 1, 1, 0]
    s = got[202]["spans"][0]
    assert "İİ vile1 é"[s["start"] : s["end"]] == "vile1"
    assert toxicity.fit(docs.limit(0), labels, F.lit(True)) is None and toxicity.fit(docs, labels.limit(0), F.lit(True)) is None
    assert [r["score"] for r in toxicity.score(docs.limit(1), None).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0
