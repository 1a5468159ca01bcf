"""Exact quantiles from brackets against numpy."""

import math

import numpy as np
import pytest

from quotalens.operators import features
from quotalens.operators.diagnostics import model_diagnostics


def table(spark, columns):
    n = max(map(len, columns.values()))
    rows = [tuple(float(c[k]) if k < len(c) and c[k] is not None else None for c in columns.values()) for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


def some_columns(n=20_000, seed=3):
    rng = np.random.default_rng(seed)
    heavy = rng.normal(size=n)
    heavy[rng.random(n) < 0.4] = 0.25
    return {
        "smooth": rng.normal(size=n), "tied": rng.integers(0, 3, n), "heavy": heavy, "constant": np.full(n, 7.0),
        "wide": np.exp(rng.normal(0, 20, n)), "gaps": [None if rng.random() < 0.3 else (float("nan") if rng.random() < 0.1 else x) for x in rng.normal(size=n)],
        "signs": rng.choice([-1.0, 1.0, 0.0, -0.0], n), "one": [3.5], "none": [None] * n, "two": [1.0, 2.0], "ends": np.where(np.arange(n) % 2 == 0, -math.inf, math.inf)[:n - 1],
    }


@pytest.mark.parametrize("p", [0.0, 0.0004, 0.25, 0.5, 0.9995, 1.0])
@pytest.mark.parametrize("rows_per_task", [1_000_000, 7])
def test_quantiles_equal_numpy(spark, p, rows_per_task):
    columns = some_columns(4000)
    columns.pop("ends")
    got = {r.feature: (r.known_n, r.quantile) for r in features.exact_quantile(table(spark, columns), list(columns), p, rows_per_task).collect()}
    for name, values in columns.items():
        known = np.array([x for x in values if x is not None and x == x], float)
        if not len(known):
            assert name not in got
            continue
        n, q = got[name]
        assert n == len(known) and math.isclose(q, np.quantile(known, p), rel_tol=1e-12, abs_tol=1e-300)


def test_only_values_in_brackets_are_shuffled(spark):
    columns = {k: v for k, v in some_columns().items() if k in ("smooth", "wide", "gaps")}
    df = table(spark, columns)
    brackets = features.quantile_brackets(df, list(columns), 0.5)
    held = {r.feature: r["count"] for r in features.bracketed_values(df, brackets).groupBy("feature").count().collect()}
    assert all(1 <= held[c] <= 2.5 * (features.MARGIN + 1 / features.ACCURACY) * b.known_n + 2 for c, b in brackets.items())
    assert features.value_counts(df, ["smooth"]).count() == 20_000  # what was shuffled before


def test_a_bracket_that_misses_falls_back_to_everything(spark, monkeypatch):
    columns = {"smooth": some_columns()["smooth"]}
    df = table(spark, columns)
    monkeypatch.setattr(features, "ACCURACY", 2)  # a useless sketch
    monkeypatch.setattr(features, "MARGIN", 0.0)
    brackets = features.quantile_brackets(df, ["smooth"], 0.37)
    assert brackets["smooth"].low == -math.inf
    got = features.exact_quantile(df, ["smooth"], 0.37).first()
    assert math.isclose(got.quantile, np.quantile(columns["smooth"], 0.37), rel_tol=1e-12)


def test_no_rows_and_no_known_values(spark):
    empty = table(spark, {"a": [1.0]}).limit(0)
    assert features.exact_quantile(empty, ["a"]).count() == 0
    assert features.exact_quantile(table(spark, {"a": [None, None]}), ["a"]).count() == 0


def test_tied_scores_need_no_slices(spark, monkeypatch):
    from quotalens.operators import diagnostics

    rows = spark.createDataFrame([("t", k, float(k % 5), k % 2) for k in range(2000)], "target string, pos long, score double, y int")
    seen = []
    plain = diagnostics.slices_for
    monkeypatch.setattr(diagnostics, "slices_for", lambda n, size: seen.append(n) or plain(n, size))
    sliced = model_diagnostics(rows, rows_per_task=100).collect()
    assert seen == [5] and sliced == model_diagnostics(rows).collect()
