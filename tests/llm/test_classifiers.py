"""Language and quality: held-out accuracy, whole texts, odd rows."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import clashing, documents, odd_texts, words
from quotalens.llm import language, quality

FOLDER = "/root/testdata/sf0.01"
ALPHABETS = {"aa": "abcdefg", "bb": "nopqrst", "cc": "äöüxyz"}


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3


def speech(spark, n=240):
    rows = [(k, words(k, 30, ALPHABETS[x]), x, "s", 0) for k in range(n) for x in [sorted(ALPHABETS)[k % 3]]]
    return spark.createDataFrame(rows + [(9000, "abc", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")


def test_languages_are_told_apart(spark):
    df = speech(spark)
    model = language.fit_languages(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = language.identify(df, model).filter(F.col("lang").isNotNull()).collect()
    assert np.mean([r.lang == r.lang_pred for r in got if fold(r.doc_id) == 1]) == 1.0
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_not_learned(spark):
    df = speech(spark)
    other = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    one, two = language.fit_languages(df), language.fit_languages(other)
    assert two.languages == one.languages and np.array_equal(one.table, two.table)


def test_languages_of_odd_rows(spark):
    model = language.fit_languages(speech(spark))
    rows = odd_texts() + [(50, "12 34 ,."), (51, "é")]
    got = language.identify(clashing(documents(spark, rows)), model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.languages
    assert language.fit_languages(documents(spark, [])) is None
    assert {r.lang_pred for r in language.identify(documents(spark, rows), None).collect()} == {"und"}


def test_language_reads_the_whole_text(spark):
    model = language.fit_languages(speech(spark))
    texts = [words(1, 200, "abcdefg") + " " + words(2, 4000, "nopqrst"), words(3, 100_000, "nopqrst")]
    assert language.predict(model, texts)[0] == ["bb", "bb"]


def test_bucket_sums_do_not_depend_on_pieces(monkeypatch):
    text = words(8, 3000)
    model = language.train([words(1, 30, "abc"), words(2, 30, "xyz")], ["a", "b"])
    whole = language._logits(model, [text])
    monkeypatch.setattr(language, "_PIECE", 500)
    assert np.allclose(whole, language._logits(model, [text]))


def test_language_accuracy_on_documents(spark):
    from quotalens.llm.queries import QUERIES

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op10_language"](spark, FOLDER).collect()
    assert len(got) == len(truth) and all(r.held_out == (fold(r.doc_id) == 1) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.held_out]) > 0.98
    assert np.mean([r.rejected for r in got]) < 0.01


def test_quality_accuracy_on_documents(spark):
    from quotalens.llm.queries import QUERIES

    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = QUERIES["op3_quality"](spark, "/root/testdata/sf0.1").collect()
    known = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in known]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_of_odd_rows(spark):
    rows = odd_texts()
    docs = documents(spark, rows)
    known = labels(spark, [(0, 1, 0), (1, 0, 0), (3, 1, 0), (4, 0, 1), (5, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0)])
    net = quality.fit_quality(docs, known)
    got = quality.score_quality(clashing(docs), net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert quality.score_quality(documents(spark, []), net).count() == 0
    assert quality.fit_quality(docs, labels(spark, [])).score(b"x") == 0.5
    assert quality.fit_quality(docs, labels(spark, [(0, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 1, 0), (1, 1, 0), (2, 1, 0)])).score(b"x") == 1.0


def test_blocks_do_not_change_the_score(monkeypatch):
    net = quality.Network()
    data = words(4, 4000).encode()
    whole = net.score(data)
    monkeypatch.setattr(quality, "_BLOCK", 1024)
    assert net.score(data) == pytest.approx(whole, rel=1e-5)


def test_gradient_equals_differences():
    net = quality.Network()
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    data, label, step = words(5, 60).encode(), 1, 1e-5
    grads = net.gradient(data, label)
    loss = lambda: -np.log(net.score(data))
    rng = np.random.default_rng(1)
    for k, g in grads.items():
        spots = np.argsort(-np.abs(g).ravel())[:20]
        for s in rng.choice(spots, 4):
            flat = net.w[k].reshape(-1)
            kept = flat[s]
            flat[s] = kept + step
            up = loss()
            flat[s] = kept - step
            down = loss()
            flat[s] = kept
            assert (up - down) / (2 * step) == pytest.approx(g.ravel()[s], rel=0.02, abs=1e-5)


def test_language_of_many_texts_needs_little_memory_at_a_time(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(1000)) for _ in range(1500)]
    table = np.random.default_rng(8).normal(size=((1 << language.BITS) + 1, 5)).astype(np.float32)
    model = language.LanguageModel(["a", "b", "c", "d"], table, np.zeros(4), 1.0, 0.5)
    tracemalloc.start()
    got = language.predict(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    monkeypatch.setattr(language, "_AT_ONCE", 1 << 18)
    assert language.predict(model, texts) == got
