"""The corpus pipeline: every stage against what it should keep, on planted documents."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import words

SECRET = 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"'


def planted(spark, folder):
    langs = {"aa": "abcdefg", "bb": "nopqrst"}
    rows = [(k, words(k, 60, langs[x]), x, "s", 0) for k in range(120) for x in [("aa", "bb")[k % 2]]]
    item = words(500, 30, "abcdefg")
    text = dict((r[0], r[1]) for r in rows)
    rows += [
        (200, text[0], "aa", "s", 0), (201, text[1].upper() + "!", "bb", "s", 0), (202, text[2] + " bad", "aa", "s", 0), (202, text[2] + " bad", "aa", "s", 0),
        (210, words(211, 20, "abcdefg") + " " + item + " " + words(212, 20, "abcdefg"), "aa", "s", 0), (220, words(221, 40, "abcdefg") + " " + SECRET, "aa", "s", 0),
        (230, None, None, None, None), (231, "", "aa", "s", 0), (232, "123 456 ...", "bb", "s", 0), (None, words(240, 30, "nopqrst"), "bb", "s", 0),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return text


def test_stages(spark, folder):
    text = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    ids = {name: sorted(-1 if r.doc_id is None else r.doc_id for r in rows) for name, rows in kept.items()}
    clean = list(range(120))
    assert ids["language"] == [-1, *clean, 200, 201, 202, 202, 210, 220]
    assert ids["near_duplicates"] == [-1, *clean, 210, 220]
    assert ids["decontamination"] == [-1, *clean, 220] == ids["secrets"] == ids["bpe"]
    hidden = {r.doc_id: r for r in kept["secrets"]}
    assert "f33e61" not in hidden[220].text and hidden[220].text.endswith('token = "[secret]"') and hidden[220].n_chars == len(hidden[220].text)
    assert all(hidden[k].text == text[k] for k in clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in kept["bpe"]:
        assert r.round_trip and list(memoryview(bytes(r.ids)).cast("I")) == library.encode(hidden[r.doc_id].text, add_special_tokens=False).ids


def test_run_equals_the_stages(spark, folder):
    planted(spark, folder)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == [-1, *range(120), 220]


def test_empty_tables(spark, folder):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
