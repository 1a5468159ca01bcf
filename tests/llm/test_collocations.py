"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import clashing, odd_texts
from quotalens.llm import collocations as co

ROWS = "doc_id long, text string, lang string"


def plain_counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, threshold, reported):
    f, n = plain_counts(rows)
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    out = {}
    for (lang, w), a in found.items():
        around = any(lang == other and len(v) > len(w) and 100 * b >= 100 * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                     for (other, v), b in found.items())
        if not around:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, best in out.items()
                  for rank, (score, a, p, l, r) in enumerate(sorted(best)[:reported], 1))


def some_rows(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "straße", "ÉTÉ", "été", "x y", "a'b", "\0", "1.5", "co-op"]
    out = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["new york city hall", "of the", *vocabulary]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!\r", " \x0b"]))
        out.append((k, "".join(parts), rng.choice(["en", "fr", None, "und", ""])))
    return out + out[:20] + [(None, "the of " * 40, "en")]


@pytest.mark.parametrize("threshold, reported", [(3, 2000), (12, 7), (100, 2000)])
def test_rows_equal_plain_counting(spark, threshold, reported):
    rows = some_rows() + [(i, t, None) for i, t in odd_texts()]
    df = clashing(spark.createDataFrame(rows, ROWS)).selectExpr("*", "1 AS n", "2 AS rank", "'x' AS phrase", "3 AS a", "4 AS words").repartition(5)
    got = co.collocations(df, threshold=threshold, reported=reported, bits=1 << 16)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, threshold, reported)


@pytest.mark.parametrize("setting", ["filter", "summary", "blocks"])
def test_bounds_change_no_row(spark, monkeypatch, setting):
    rows = some_rows(5)
    if setting == "summary":  # tasks hand on few phrases, partitions are many
        monkeypatch.setattr(co, "TOGETHER", 64)
        monkeypatch.setattr(co, "BUCKET_MASS", 20)
        monkeypatch.setattr(co, "_HELD", 8)
    if setting == "blocks":  # every text is a very long one
        monkeypatch.setattr(co, "BLOCK", 9)
    bits = 64 if setting == "filter" else 1 << 16  # all bits are set: everything is counted
    got = co.collocations(spark.createDataFrame(rows, ROWS), threshold=4, bits=bits)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 2000)


def test_a_language_with_most_rows_and_big_numbers(spark):
    rows = [(k, "big apple pie. " * 200, "en") for k in range(600)] + [(0, "un deux", "fr")] * 130
    got = co.collocations(spark.createDataFrame(rows, ROWS))
    assert sorted(map(tuple, got.collect())) == plain(rows, 100, 2000)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "en")]])
def test_nothing_frequent(spark, rows):
    assert co.collocations(spark.createDataFrame(rows, ROWS)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=120), max_size=8), st.integers(2, 30))
def test_summaries_lose_no_frequent_item(parts, threshold):
    true = Counter(x for p in parts for x in p)
    summary = co.Summary(co.capacity_of(sum(true.values()), threshold))
    for p in parts:
        items, n = np.unique(np.array(p, np.uint64), return_counts=True)
        summary.merge(items, n)
        assert len(summary.counts) <= summary.capacity
    assert summary.lost <= threshold / 2
    assert {x for x, n in true.items() if n >= threshold} <= set(summary.candidates(threshold).tolist())
    assert all(true[x] - summary.lost <= n <= true[x] for x, n in zip(summary.hashes.tolist(), summary.counts.tolist()))


def test_parts_of_a_long_text_count_every_phrase_once(monkeypatch):
    text = "".join(random.Random(1).choice(["a", "bb", "ccc" * 9, " ", "\t", ".", "\n"]) for _ in range(3000))
    whole = Counter(tuple(w) for piece in re.split(r"[.\n]", text) for k in range(1, 6)
                    for w in [re.findall(r"[^ \t]+", piece)] for w in [w[i:i + k] for i in range(len(w) - k + 1)])
    for size in (1, 7, 40, 1000, 1 << 20):
        monkeypatch.setattr(co, "BLOCK", size)
        found = Counter()
        for words in co.split([("en", text)]):
            hashes = co.word_hashes(words)
            strings = [words.data[a:b].decode() for a, b in zip(words.start, words.stop)]
            for n in range(1, 6):
                found.update(tuple(strings[k:k + n]) for k in co.phrase_hashes(words, hashes, n)[0].tolist())
        assert found == whole
