"""Exact top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quotalens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, size string, bucket string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i, tuple(math.floor(256 * x) for x in v)] = None
    out = set()
    for qi, q in held:
        if asked(qi):
            found = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in held if ci != qi and len(c) == len(q))
            out |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(found[:k])}
    return out


def near(x):
    return [float.fromhex(float(y).hex()) for y in __import__("numpy").float32(x)]


@pytest.mark.parametrize("shape", ["plain", "one vector for a third", "lengths", "few", "signs"])
def test_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SEEDS", 16)
    rng = random.Random(shape)
    rows = []
    for i in range(4 if shape == "few" else 400):
        v = [rng.gauss(0, 0.2) for _ in range(8)]
        if shape == "one vector for a third" and i % 3 == 0:
            v = [0.5] * 8
        if shape == "lengths":
            v = [x * math.exp(rng.gauss(0, 2)) for x in v]
        if shape == "signs":
            v = [-abs(x) if i % 2 else 0.0 for x in v]
        rows.append((i, near(v)))
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, lambda i: i % 20 == 0, 5)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [1.0, math.nan]), (80, [math.inf, 1.0]), (None, [9.0, 9.0]),
        (100, []), (1, []), (2, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [-1.0, -2.0]), (120, [0.0, 0.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
    ]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, lambda i: i % 20 == 0, 5)


def test_empty_table(spark):
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_leaves_out_no_partner():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        c = rng.integers(-200, 200, (60, 6))
        q, ids = rng.integers(-200, 200, 6), np.arange(60)
        scores = c @ q
        limit = float(np.sort(scores)[-rng.integers(1, 20)])
        lengths = np.sqrt((c.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths)
        got = topk.retrieve(q, -1, limit, ids[order], c[order], lengths[order], 5)
        want = sorted(((-s, i) for i, s in enumerate(scores) if s >= limit))[:5]
        assert got == [(int(i), int(-s)) for s, i in want]
