"""Language identification: held-out accuracy, calibration, defined results."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from facetledger.llm import language_id as op
from facetledger.llm.queries import QUERIES
from facetledger.llm.sample import sample_ids, with_texts


@pytest.fixture(scope="module")
def model(spark):
    return op.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op1_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.15 * len(rows) < len(held) < 0.35 * len(rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_most_weights_are_zero(model):
    assert model.languages == ["de", "en", "es", "fr"]
    assert (model.weights == 0).mean() > 0.5


def test_odd_texts(spark, model):
    texts = [None, "", "  \n", "123 !!", "the", "É", "ß " * 40000, "the and of this with " * 20000, "日本語"]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, score="clash", extra=i) for i, t in enumerate(texts)] * 2)
    rows = op.predict(docs, model).collect()
    assert len(rows) == 2 * len(texts)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in range(4)] == ["und"] * 4 and [by[i].score for i in range(4)] == [0.0] * 4
    assert by[7].lang_pred == "en" and by[6].lang_pred == "de"
    assert all(r.extra == r.doc_id and (r.lang_pred, r.score) == (by[r.doc_id].lang_pred, by[r.doc_id].score) for r in rows)
    kept = op.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {4, 7} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id < 4").count() == 0
    assert kept.select("score").distinct().first()[0] == "clash"


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op.fit(empty) is None
    rows = op.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert op.predict(empty, None).count() == 0


def test_learns_only_from_training_rows(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = docs.withColumn("lang", F.when(op.remainder(4) == 2, F.lit("z")).otherwise(F.col("lang")))
    a, b = op.fit(docs), op.fit(held)
    assert a.languages == b.languages == ["x", "y"]
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in op.softmax(logits)])
    assert 0.8 < op.fit_temperature(logits, labels) < 1.25
    assert 2.4 < op.fit_temperature(logits * 3, labels) < 3.6


def test_grams_do_not_cross_texts():
    one = [next(op.gram_counts([t])) for t in ("ab c", "", "Zé")]
    assert all(np.array_equal(a, b) for a, b in zip(one, op.gram_counts(["ab c", "", "Zé"]), strict=True))
    assert next(op.gram_counts(["  --  "])).sum() == 0


def test_learns_from_long_texts(spark):
    rows = [(i, ("aaa bbb " if i % 2 else "ccc ddd ") * (20 if i % 2 else 40 + i), "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit in (200, 16):  # the texts of y, or all, are longer than the limit
        model = op.fit(docs, per_language=5, limit_bytes=limit)
        assert model.languages == ["x", "y"]
        assert all(r.lang == r.lang_pred for r in op.predict(docs, model).collect())


def test_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(i, "a" * n, label) for i, (n, label) in enumerate([(9, "x")] * 30 + [(25, "x"), (25, "y"), (35, "y"), (70, "y"), (10**6, "z"), (10**5, "z")])] + [(99, None, "x"), (100, "", "w")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string").repartition(3)
    ids = sample_ids(docs, docs, "lang", 6, 10)
    got = {}
    for r in with_texts(docs, ids).collect():
        got.setdefault(r.lang, []).append(len(r.text))
    assert {k: sorted(v) for k, v in got.items()} == {"x": [9] * 6, "y": [25, 35], "z": [10**5], "w": [0]}
    same = sample_ids(docs, docs.select("doc_id", "lang"), "lang", 6, 10)
    assert sorted(same.collect()) == sorted(ids.collect())
