"""Both samplers: pairing, guards, and the law of the block sampler against plain resampling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotalens.operators import bootstrap, decompose, ranking, scoring
from quotalens.operators.cohorts import scenarios
from quotalens.operators.ranking import kth_score, worklist
from quotalens.session import colocated_prefix, run_scope


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1000).select(
        F.lit("t").alias("target"), F.col("id").alias("pos"), ((F.col("id") % 13) / 13).alias("score"),
        (F.col("id") % 4 == 0).cast("int").alias("y"), F.when(F.col("id") < 700, 2).otherwise(5).alias("entry")).cache()


@pytest.fixture(scope="module")
def budgets(table):
    return decompose.decomposition(decompose.four_cells(worklist(table, scenarios()))).cache()


def test_weights_equal_expansion(table, budgets):
    drawn = bootstrap.resample(table, 3, 11)
    got = bootstrap.cell_tp(bootstrap.resampled_worklist(drawn, rows_per_task=200), budgets).toPandas()
    rows = drawn.toPandas()
    assert rows.groupby("replicate").w.sum().eq(1000).all()
    size = budgets.toPandas().set_index("nominal_fraction")
    for r in got.itertuples():
        sample = rows[rows.replicate == r.replicate]
        if r.cell in ("C00", "C01"):
            sample = sample[sample.entry.between(1, 3)]
        sample = sample.sort_values(["score", "pos"], ascending=[False, True])
        copies = np.repeat(sample.y.to_numpy(), sample.w.to_numpy())
        b = size.loc[r.nominal_fraction, "B_early" if r.cell in ("C00", "C10") else "B_all"]
        assert r.true_positive_n == copies[:b].sum()


def plain_resamples(table, budgets, repeats=1500):
    rows = table.toPandas().sort_values(["score", "pos"], ascending=[False, True])
    y, early = rows.y.to_numpy(), rows.entry.between(1, 3).to_numpy()
    b = budgets.toPandas().set_index("nominal_fraction").loc[0.1]
    rng, out = np.random.default_rng(5), []
    for _ in range(repeats):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
        row = {"events": (w * y).sum()}
        for cell, mask, n in (("C00", early, b.B_early), ("C10", early | True, b.B_early), ("C01", early, b.B_all), ("C11", early | True, b.B_all)):
            row[cell] = np.repeat(y, w * mask)[: int(n)].sum()
        out.append(row)
    return pd.DataFrame(out)


@pytest.mark.parametrize("fan_out", [2000, 12])
def test_block_law(table, budgets, fan_out):
    got = bootstrap.cell_replicates(bootstrap.block_cell_tp(table, budgets, 600, 3, fan_out=fan_out)).toPandas()
    assert got.groupby("nominal_fraction").replicate.nunique().eq(600).all()
    got = got[got.nominal_fraction == 0.1]
    want = plain_resamples(table, budgets)
    for mine, theirs in (("full_event_n", "events"), ("C00_tp", "C00"), ("C10_tp", "C10"), ("C01_tp", "C01"), ("C11_tp", "C11")):
        spread = want[theirs].std()
        assert abs(got[mine].mean() - want[theirs].mean()) < 5 * spread * np.sqrt(1 / 600 + 1 / 1500)
        assert 0.85 < got[mine].std() / spread < 1.15
    # Pairing: cells of a replicate move together as they do in plain resamples.
    assert abs(got.C01_tp.corr(got.C11_tp) - want.C01.corr(want.C11)) < 0.12
    assert abs(got.C10_tp.corr(got.C11_tp) - want.C10.corr(want.C11)) < 0.12
    # More selections from one resampled ranking never lose events.
    assert (got.C01_tp >= got.C00_tp).all() and (got.C11_tp >= got.C10_tp).all()


def test_block_bootstrap_is_reproducible(table, budgets):
    a, b = (bootstrap.block_cell_tp(table, budgets, 30, 9).toPandas().sort_values(["replicate", "nominal_fraction", "cell"]).reset_index(drop=True) for _ in range(2))
    assert a.equals(b)


def test_block_protocols(table):
    cuts = kth_score(table, (0.05, 0.1))
    got = bootstrap.block_protocol_counts(table, cuts, 50, 1).toPandas()
    assert len(got) == 50 * 18
    own = got[got.protocol == "cohort_specific_top_fraction"]
    assert own[own.scenario == "all_record_upper_bound"].groupby("nominal_fraction").selected_n.nunique().eq(1).all()
    cut = got[got.protocol == "fixed_calibration_threshold"]
    wide = cut.pivot_table(index=["replicate", "nominal_fraction"], columns="scenario", values="selected_n")
    assert (wide["early_entry"] <= wide["any_prenatal_care"]).all() and (wide["any_prenatal_care"] <= wide["all_record_upper_bound"]).all()
    point = bootstrap.protocol_replicates(bootstrap.protocol_counts(bootstrap.resampled_worklist(bootstrap.resample(table, 5, 2)), cuts))
    assert point.count() == 5 * 18


def test_stretch_sizes():
    assert bootstrap.stretch_sizes(1000, 2000) == [1]
    assert bootstrap.stretch_sizes(10**12, 2000)[-1] == 1
    last = 10**12
    for size in bootstrap.stretch_sizes(10**12, 2000):
        assert -(-last // size) <= 2000 + 1
        last = size


def test_stretches_nest():
    for largest in (1, 2, 950, 8_999_999, 10**9 + 7):
        for fan_out in (10, 2000):
            sizes = bootstrap.stretch_sizes(largest, fan_out)
            assert sizes[-1] == 1 and sizes[0] * fan_out >= largest
            assert all(longer % shorter == 0 for longer, shorter in zip(sizes, sizes[1:]))


def test_block_protocols_over_three_levels(table):
    """950 records in lengths 95, 10 and 1 had stretches of two parents; a second request then met the first one's copies."""
    rows = table.where("pos < 950")
    got = bootstrap.block_protocol_counts(rows, kth_score(rows, (0.05, 0.1)), 60, 1, fan_out=10).toPandas()
    assert len(got) == 60 * 18 and got.bootstrap_sample_n.eq(950).all()


def test_no_events_fails(spark):
    rows = spark.range(50).select(F.lit("t").alias("target"), F.col("id").alias("pos"), F.col("id").cast("double").alias("score"),
                                  F.lit(0).alias("y"), F.lit(1).alias("entry"))
    cuts = spark.createDataFrame([("t", 0.05, 1.0), ("t", 0.1, 1.0)], "target string, nominal_fraction double, threshold double")
    with pytest.raises(Exception, match="no events"):
        bootstrap.block_protocol_counts(rows, cuts, 2, 1).collect()


def test_resample_leaves_the_ranking_where_it_is(spark, table):
    order = ranking.ranked(table, ["target"]).drop("cum_event_n")
    stored, buckets = bootstrap._stored_ranking(order, ["target"], 100)
    hits = bootstrap._hits(stored, ["target"], 4, 3, buckets)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert buckets == 10 and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the draws
    assert {r.pos for r in hits.filter("replicate = 0").collect()} <= set(range(1000))


def test_run_scope_drops_bucketed_tables(spark, table):
    with run_scope(spark):
        bootstrap.resample(table, 2, 1)
        assert [t for t in spark.catalog.listTables(pattern=f"{colocated_prefix(spark)}*")]
        mark = colocated_prefix(spark)
    assert not spark.catalog.listTables(pattern=f"{mark}*")


def test_rank_agreement_joins_nothing(spark, table):
    rows = table.withColumn("p", F.col("pos") % 7 / 7.0)
    want = rows.toPandas()
    one = want.sort_values(["score", "pos"], ascending=[False, True]).pos.to_numpy()
    two = want.sort_values(["p", "pos"], ascending=[False, True]).pos.to_numpy()
    moved = int((np.argsort(one) != np.argsort(two)).sum())
    for rows_per_task in (10**6, 90):
        got = scoring.rank_agreement(rows, "p", rows_per_task=rows_per_task)
        if rows_per_task > 1000:
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.first().asDict() == {"target": "t", "rows": 1000, "moved_n": moved}
