import zlib

import numpy as np
import pytest

from quayside.llm import language

from . import cases


def test_held_out_accuracy_and_calibration(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = language.op7_language_id(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    right = np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held])
    assert right >= 0.95
    assert abs(right - np.mean([r["score"] for r in held])) < 0.1


def test_labels_of_held_out_rows_are_not_learnt(spark):
    ids = range(400)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, "abc abd" if i % 2 else "xyz xzy", "zz" if held(i) else "aa" if i % 2 else "xx", "s", 0) for i in ids]
    model = language.train(spark.createDataFrame(rows, cases.SCHEMA))
    assert model.languages == ["aa", "xx"]
    assert model.predict("abd abc")[0] == "aa" and model.predict("zyx xyz")[0] == "xx"
    assert model.predict("123 !?") == ("und", 0.0)
    assert all(model.predict(x) == ("und", 0.0) for x in ("²", "½ Ⅷ", "٣ _", "", "\u0301"))
    assert all(model.predict(x)[0] != "und" for x in ("ª", "漢", "ʰ", "1é"))


def test_long_and_short_ways_agree():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.normal(size=(language.BUCKETS + 1, 2)).astype(np.float32), 1.0)
    text = "the quick brown fox " * 2000
    own = language.grams(text)
    logits = model.weights[own].astype(np.float64).mean(axis=0) + model.weights[-1]
    p = np.exp(logits - logits.max())
    assert len(own) > language.BUCKETS and model.predict(text)[1] == pytest.approx(p.max() / p.sum())


def test_document_frequencies(spark):
    texts = [t for t in cases.texts() if t]
    df, n = language.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    expected = np.zeros(language.BUCKETS, dtype=int)
    for t in texts:
        expected[np.unique(language.grams(t))] += 1
    assert n == len(texts) and (df == expected).all()


def test_penalty_makes_weights_sparse():
    rows = [(k % 2, np.array([k % 2, 2 + k % 50]), np.array([1.0, 0.01])) for k in range(400)]
    weights = language.fit_ftrl(rows, 2, l1=0.5)
    assert (weights[2:52] == 0).all() and weights[0, 0] > 0 > weights[0, 1]


def test_temperature_sharpens_or_softens():
    logits = np.array([[1.0, 0.0]] * 10)
    assert language.fit_temperature(logits, np.array([0] * 10)) < 0.1
    assert language.fit_temperature(10 * logits, np.array([0] * 6 + [1] * 4)) > 10


def test_odd_tables(spark):
    docs = cases.documents(spark)
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == docs.count()
    assert {r["lang_pred"] for r in got if r["id"] in (4, 5, 6, 17)} == {"und"}
    assert language.train(cases.nothing(spark)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(cases.nothing(spark), None).count() == 0
    kept = language.language_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert not {4, 5, 6, 17} & {r["doc_id"] for r in kept.collect()}
