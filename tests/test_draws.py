"""Packed draws against the row form, draw for draw, over several stretches, steps and parts of a replicate."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from quotalens.operators import bootstrap, decompose, draws
from quotalens.operators.cohorts import scenarios
from quotalens.operators.ranking import kth_score, worklist
from quotalens.plans.catalog import QUERIES
from quotalens.session import materialize, run_scope, shuffles_dropped

SMALL = dict(stretch=256, step=32, draws=300)


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(2500).select(
        F.when(F.col("id") < 2300, "t").otherwise("small").alias("target"), F.col("id").alias("pos"), ((F.col("id") % 13) / 13).alias("score"),
        (F.col("id") % 4 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 9 != 0, F.when(F.col("id") % 3 < 2, 2).otherwise(5)).alias("entry")).cache()


@pytest.mark.parametrize("prefix", ["2027|is_f|17", "7|" + "long " * 30 + "é|3"])
def test_uniforms_are_md5(prefix):
    got = draws.uniforms(prefix, 5, 12_345)
    for i in (5, 9, 10, 99, 100, 999, 1000, 9_999, 10_000, 12_344):
        assert got[i - 5] == int(hashlib.md5(f"{prefix}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)


def test_draws_equal_the_row_form(spark, table):
    rows = bootstrap.resample(table, 6, 11)
    packed = draws.draw_worklist(table, scenarios(), 6, 11, rows_per_task=1000, **SMALL)
    want = rows.groupBy("target", "replicate").agg(
        F.sum("w").alias("drawn_n"), F.count(F.lit(1)).alias("distinct_n"), F.max("w").alias("largest_w"), F.sum(F.col("w") * F.col("y")).alias("event_n"))
    assert sorted(draws.draw_counts(packed).collect()) == sorted(want.collect())
    every = packed.of_buckets(packed.hist).select("target", "replicate", "pos", "score", "y", "w")
    assert sorted(every.collect()) == sorted(rows.select("target", "replicate", "pos", "score", "y", "w").collect())


def test_answers_equal_the_row_form(table):
    budgets = decompose.decomposition(decompose.four_cells(worklist(table, scenarios())))
    cuts = kth_score(table, (0.05, 0.1))
    rows = bootstrap.resampled_worklist(bootstrap.resample(table, 6, 11))
    packed = draws.draw_worklist(table, scenarios(), 6, 11, **SMALL)
    for ask in (lambda work: bootstrap.cell_tp(work, budgets), lambda work: bootstrap.protocol_counts(work, cuts)):
        mine, theirs = ask(packed), ask(rows)
        assert sorted(map(str, mine.select(*theirs.columns).collect())) == sorted(map(str, theirs.collect()))


def test_a_draw_is_no_row(table):
    packed = draws.draw_worklist(table, scenarios(), 40, 11, **SMALL)
    assert packed.packets.count() < 40 * 2500 / 10  # 40 * 2500 draws; the row form exchanges each


def test_waves_answer_as_the_row_form(table):
    """Six replicates in three waves and a group that is all in one of its parts."""
    cuts = materialize(kth_score(table, (0.05, 0.1)), "cuts")
    want, asked = bootstrap.protocol_counts(bootstrap.resampled_worklist(bootstrap.resample(table, 6, 11)), cuts), []

    def ask(work):
        asked.append(sorted(r[0] for r in work.totals.select("replicate").distinct().collect()))
        return bootstrap.protocol_counts(work, cuts)

    got = draws.in_waves(table, scenarios(), 6, 11, ask, wave=5000, **SMALL)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert asked == [[0, 1], [2, 3], [4, 5]]


def packets_in(folder):
    return sum(d.startswith("packets-") for _, folders, _ in os.walk(folder) for d in folders)


@pytest.mark.parametrize("name", ["bootstrap_summary", "bootstrap_intervals", "audit_report"])
def test_draws_go_with_their_wave(spark, monkeypatch, name):
    """All draws of 500 replicates used to lie on disk until the run's end, and twice, with their shuffle files."""
    held, totals = [], draws.totals_of
    monkeypatch.setattr(draws, "WAVE", 600_000, raising=False)
    with run_scope(spark) as folder:
        monkeypatch.setattr(draws, "totals_of", lambda *parts: held.append(packets_in(folder)) or totals(*parts))
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert packets_in(folder) == 0
    assert held == [1, 1, 1]


def test_shuffle_files_go_with_their_query(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if f.startswith("shuffle")}

    before = shuffled()
    with shuffles_dropped(spark):
        assert materialize(spark.range(1000).repartition(7).groupBy((F.col("id") % 5).alias("k")).count(), "counted").count() == 5
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
