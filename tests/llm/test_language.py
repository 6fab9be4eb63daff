"""Output codes: held-out accuracy, and defined results of odd inputs."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import langid, queries

DATA = "/root/testdata/sf0.01"


def test_codewords_differ():
    for n in (2, 3, 4, 5, 7, 8, 30):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n and set(np.unique(c)) <= {-1, 1}
    assert langid.codewords(4).shape == (4, 7) and langid.codewords(1).shape == (1, 0)


def test_gram_counts_cover_whole_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert (langid.gram_counts(text) - whole)[langid.CELLS :].any() == False  # noqa: E712
    assert langid.gram_counts(b"").sum() == 0


def test_ambiguity_is_flagged():
    x = np.array([[1.0, 0.0], [0.0, 1.0]] * 20, dtype=np.float32)
    model = langid.fit(x, ["a", "b"] * 20, margin=0.5)
    assert model.decode(x[0])[::2] == ("a", False) and model.decode(x[1])[::2] == ("b", False)
    assert model.decode(np.array([0.5, 0.5], np.float32))[2]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_held_out_accuracy(spark):
    got = queries.op9_language(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    r = got.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("hit"), F.count("*").alias("n")).first()
    assert r["hit"] > 0.97 and r["n"] > 100
    assert got.filter("score < 0 or score > 1 or score is null or lang_pred is null").isEmpty() and got.count() == truth.count()


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score double"
    data = [(1, None, "en", 0.0), (2, "", None, 0.0), (3, "12 !?", "fr", 0.0), (None, "hello there world", "en", 0.0), (5, "hello there world " * 20000, "en", 0.0), (5, "bonjour à tous les amis", "fr", 0.0), (6, "bonjour à tous les amis", "fr", 0.0), (7, "bonjour à tous", None, 0.0), (8, "hello there", "en", 0.0), (9, "hello there", "en", 0.0)]
    got = langid.identify(spark.createDataFrame(data, schema)).collect()
    assert len(got) == len(data)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    unlabelled = langid.identify(spark.createDataFrame([(1, "abc", None, 0.0)], schema)).collect()
    assert [(r["lang_pred"], r["ambiguous"]) for r in unlabelled] == [("und", True)]


def test_codewords_tell_all_languages_apart():
    for n in range(2, 20):
        codes = langid.codewords(n).astype(int)
        assert len({tuple(r) for r in codes}) == n
        columns = [tuple(c * c[-1]) for c in codes.T]
        assert len(set(columns)) == len(columns) and all(len(set(c)) == 2 for c in columns)


def test_every_gram_is_counted(monkeypatch):
    data = bytes(np.random.default_rng(3).integers(97, 123, 50, dtype=np.uint8))
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        counts = langid.gram_counts(data)
        two = np.bincount([(a * 251 + b) * 2246822519 % (1 << 32) >> 20 for a, b in zip(data, data[1:], strict=False)], minlength=langid.CELLS)
        assert (counts[: langid.CELLS] == two).all() and counts[langid.CELLS :].sum() == 48


def test_decoding_takes_the_codeword_of_least_loss():
    rng = np.random.default_rng(4)
    names = list("abcdefghi")
    codes = langid.codewords(9)
    model = langid.Model(names, codes, rng.normal(size=(5, codes.shape[1])), rng.normal(size=codes.shape[1]), 0.05)
    for _ in range(50):
        x = rng.normal(size=5)
        outputs = [float(sum(x[i] * model.weights[i, k] for i in range(5)) + model.bias[k]) for k in range(codes.shape[1])]
        losses = [sum(math.log1p(math.exp(-c * o)) for c, o in zip(row, outputs, strict=True)) for row in codes.tolist()]
        best, second = sorted(losses)[:2]
        lang, score, close = model.decode(x)
        assert lang == names[losses.index(best)] and close == (second - best < 0.05)
        assert abs(score - 1 / sum(math.exp(best - v) for v in losses)) < 1e-9


def test_texts_without_letters(spark):
    df = spark.createDataFrame([(1, "² ½ 12 _"), (2, "ª"), (3, "日"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.Model(["xx"], langid.codewords(1), np.zeros((2 * langid.CELLS, 0)), np.zeros(0), 0.05), carry=["doc_id"]).collect()}
    assert got == {1: "und", 2: "xx", 3: "xx", 4: "und", 5: "und"}
