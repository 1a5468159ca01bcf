"""All plans of the ranking operators against brute force, with ties and one score shared by a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quotalens.functions.numeric import budget, clamped_budget
from quotalens.operators import decompose, diagnostics, selection
from quotalens.operators.cohorts import scenarios
from quotalens.operators.diagnostics import model_diagnostics
from quotalens.operators.ranking import kth_score, ranked, slices_for, top_b, worklist

ROWS = [1_000_000, 700, 40]


def population(n=3000, seed=7):
    rng = np.random.default_rng(seed)
    score = np.round(rng.normal(size=n), 2)
    score[rng.random(n) < 0.35] = 0.5
    score[:3] = [-0.0, 0.0, -0.0]
    entry = rng.integers(-1, 11, n)
    return pd.DataFrame({
        "target": np.where(rng.random(n) < 0.9, "hot", "cold"), "pos": rng.permutation(n), "score": score,
        "y": (rng.random(n) < 0.2).astype(int), "entry": pd.array(np.where(entry < 0, None, entry), dtype="Int64"),
    })


@pytest.fixture(scope="module")
def frame():
    return population()


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [(r.target, int(r.pos), float(r.score), int(r.y), None if pd.isna(r.entry) else int(r.entry)) for r in frame.itertuples()]
    return spark.createDataFrame(rows, "target string, pos long, score double, y int, entry int").cache()


def ordered(frame, target, scenario="all_record_upper_bound"):
    part = frame[frame.target == target]
    e = part.entry
    keep = {"early_entry": e.between(1, 3), "any_prenatal_care": e.between(1, 10)}.get(scenario)
    if keep is not None:
        part = part[keep.fillna(False)]
    return part.assign(score=part.score + 0.0).sort_values(["score", "pos"], ascending=[False, True])


@pytest.mark.parametrize("rows_per_task", ROWS)
def test_ranked(table, frame, rows_per_task):
    got = ranked(table, rows_per_task=rows_per_task).toPandas()
    for target in ("hot", "cold"):
        want = ordered(frame, target)
        mine = got[got.target == target].sort_values("rank")
        assert mine.pos.tolist() == want.pos.tolist()
        assert mine["rank"].tolist() == list(range(1, len(want) + 1))
        assert mine.cum_event_n.tolist() == want.y.cumsum().tolist()


@pytest.mark.parametrize("rows_per_task", ROWS)
def test_four_cells(table, frame, rows_per_task):
    got = decompose.four_cells(worklist(table, scenarios(), rows_per_task=rows_per_task)).toPandas()
    assert len(got) == 16
    for r in got.itertuples():
        want = ordered(frame, r.target, r.candidate_set)
        whole = ordered(frame, r.target)
        source = ordered(frame, r.target, "early_entry") if r.budget_source == "early" else whole
        assert r.budget_n == max(1, round(r.nominal_fraction * len(source)))
        assert r.true_positive_n == want.y.head(r.budget_n).sum()
        assert r.population_event_capture == r.true_positive_n / whole.y.sum()


@pytest.mark.parametrize("rows_per_task", ROWS)
def test_weighted_selection_equals_expansion(spark, table, frame, rows_per_task):
    weighted = table.withColumn("w", (F.col("pos") % 4).cast("int"))
    work = worklist(weighted, scenarios(), weight="w", rows_per_task=rows_per_task)
    asked = work.totals.select("target", F.lit("early_entry").alias("scenario"), F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 7, 40)])).alias("budget_n"))
    for r in top_b(work, asked).collect():
        want = ordered(frame, r.target, "early_entry")
        copies = np.repeat(want.y.to_numpy(), want.pos.to_numpy() % 4)
        assert r.true_positive_n == copies[: r.budget_n].sum()


@pytest.mark.parametrize("rows_per_task", ROWS)
def test_kth_score_and_protocols(table, frame, rows_per_task):
    cuts = kth_score(table, (0.05, 0.1), rows_per_task=rows_per_task)
    for r in cuts.collect():
        want = ordered(frame, r.target)
        assert r.threshold == want.score.iloc[max(1, round(r.nominal_fraction * len(want))) - 1]
    work = worklist(table, scenarios(), rows_per_task=rows_per_task)
    rows = selection.protocol_rows(work, cuts)
    assert rows.count() == 36
    compared = selection.comparisons(rows).toPandas()
    assert len(compared) == 36
    fixed = compared[compared.protocol == "fixed_absolute_budget"]
    assert (fixed.delta_selected_n == 0).all()


@pytest.mark.parametrize("rows_per_task", ROWS)
def test_diagnostics(table, frame, rows_per_task):
    got = diagnostics.model_diagnostics(table, rows_per_task=rows_per_task).toPandas().set_index("target")
    for target in ("hot", "cold"):
        part = frame[frame.target == target]
        p, n = part[part.y == 1].score.to_numpy(), part[part.y == 0].score.to_numpy()
        auc = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
        steps = part.groupby("score").y.agg(["size", "sum"]).sort_index(ascending=False)
        ap = (steps["sum"] / len(p) * steps["sum"].cumsum() / steps["size"].cumsum()).sum()
        assert got.loc[target, "roc_auc"] == pytest.approx(auc, abs=1e-12)
        assert got.loc[target, "pr_auc"] == pytest.approx(ap, abs=1e-12)
        assert got.loc[target, "brier"] == pytest.approx(((part.score - part.y) ** 2).mean(), abs=1e-12)


def test_tie_order(spark):
    rows = spark.createDataFrame([("t", 0, 0.5, 0, True), ("t", 1, 0.9, 0, True), ("t", 2, 0.9, 0, False), ("t", 3, 0.9, 0, True)],
                                 "target string, pos long, score double, y int, eligible boolean")
    assert [r.pos for r in ranked(rows, eligible=F.col("eligible")).orderBy("rank").collect()] == [1, 3, 0]


def test_budgets_round_half_to_even(spark):
    rows = spark.range(0, 20001).select("id", budget(0.05, F.col("id")).alias("a"), clamped_budget(0.05, F.col("id")).alias("b")).collect()
    assert all(r.a == max(1, round(0.05 * r.id)) and r.b == round(0.05 * r.id) for r in rows)


def test_too_large_budget_fails(spark):
    rows = spark.range(100).select(F.lit("t").alias("target"), F.col("id").alias("pos"), F.col("id").cast("double").alias("score"),
                                   (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") < 5, 1).otherwise(0).alias("entry"))
    with pytest.raises(Exception, match="exceeds"):
        decompose.four_cells(worklist(rows, scenarios())).collect()


def test_equal_budget(spark):
    rows = spark.range(1000).select(
        F.lit("t").alias("target"), F.col("id").alias("pos"), ((F.col("id") % 5) / 5).alias("score"),
        (F.col("id") % 7 == 0).cast("int").alias("y"), F.when(F.col("id") < 700, 2).otherwise(5).alias("entry"))
    size = {(r.nominal_fraction, r.cell): r.selected_n for r in decompose.four_cells(worklist(rows, scenarios())).collect()}
    for q in (0.05, 0.1):
        assert size[q, "C00"] == size[q, "C10"] == round(700 * q)
        assert size[q, "C01"] == size[q, "C11"] == round(1000 * q)


def test_select_top_returns_the_prefix(table, frame):
    work = worklist(table, scenarios(), rows_per_task=300)
    asked = work.totals.select("target", F.lit("any_prenatal_care").alias("scenario"), F.lit(50).cast("long").alias("budget_n"))
    got = selection.select_top(work.rows, work, asked).toPandas()
    for target in ("hot", "cold"):
        assert set(got[got.target == target].pos) == set(ordered(frame, target, "any_prenatal_care").pos.head(50))


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50])
@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), float("-inf")])
def test_every_plan_refuses_scores_that_are_not_finite(spark, rows_per_task, bad):
    rows = [("t", i, float(i % 7), i % 2) for i in range(400)] + [("t", 400, bad, 0)]
    df = spark.createDataFrame(rows, "target string, pos long, score double, y int")
    for run in (
        lambda: kth_score(df, (0.1,), rows_per_task=rows_per_task), lambda: ranked(df, rows_per_task=rows_per_task),
        lambda: model_diagnostics(df, rows_per_task=rows_per_task),
    ):
        with pytest.raises(PySparkException, match="score is not finite"):
            run().collect()


@pytest.mark.parametrize("rows_per_task", [1_000_000, 50])
def test_requests_without_a_boundary_fail(spark, rows_per_task):
    df = spark.createDataFrame([("t", i, float(i % 7), i % 2) for i in range(400)], "target string, pos long, score double, y int")
    work = worklist(df, {"all": F.lit(True), "few": F.col("pos") < 10}, rows_per_task=rows_per_task)
    ask = lambda *rows: top_b(work, spark.createDataFrame(list(rows), "target string, scenario string, budget_n bigint")).collect()
    assert len(ask(("t", "few", 10), ("t", "all", 400))) == 2
    for wrong in (("t", "few", 11), ("u", "all", 1), ("t", "none", 1)):
        with pytest.raises(PySparkException, match="no boundary"):
            ask(wrong)


def test_slices_are_many_and_even(spark):
    rows = b_orders(spark)
    n, asked = rows.count(), 500
    sliced = rows.repartitionByRange(slices_for(n, asked), "target", F.col("score").desc(), "pos").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in sliced.collect()]
    assert len(sizes) > 4 and max(sizes) <= 3 * asked
    assert slices_for(500, 500) == 0 and slices_for(501, 500) == 2


def b_orders(spark):
    from quotalens.plans.bindings import orders_population

    return orders_population(spark, "/root/testdata/sf0.001")
