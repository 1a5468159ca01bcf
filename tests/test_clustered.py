"""Buckets of each group, populations stored in ranking order, and stores that grow by periods, against plans that read everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.names import ALL, EARLY, FRACTIONS
from quotalens.operators import decompose, selection
from quotalens.operators.cohorts import scenarios
from quotalens.operators.ranking import add_bucket, group_cuts, kth_of, kth_score, top_b, worklist
from quotalens.sources import clustered
from test_ranking import population


def rows_of(spark, frame):
    rows = [(r.target, int(r.pos), float(r.score), int(r.y), None if r.entry is None or r.entry != r.entry else int(r.entry))
            for r in frame.astype({"entry": object}).where(frame.notna(), None).itertuples()]
    return spark.createDataFrame(rows, "target string, pos long, score double, y int, entry int")


@pytest.fixture(scope="module")
def table(spark):
    return rows_of(spark, population()).cache()


def everybody():
    return {ALL: F.lit(True), **scenarios()}


def same(a, b):
    order = sorted(a.columns)
    assert sorted(b.columns) == order
    key = lambda r: [repr(x) for x in r]
    assert sorted(map(tuple, a.select(*order).collect()), key=key) == sorted(map(tuple, b.select(*order).collect()), key=key)


# --- Buckets of each group ----------------------------------------------------------------------------------------

def test_groups_on_other_scales_get_buckets_of_their_own(spark):
    rng = np.random.default_rng(1)
    scale = {"a": 1.0, "b": 1e9, "c": 1e-9, "small": 5.0}
    data = [(g, k, float(s * x)) for g, s in scale.items() for k, x in enumerate(rng.normal(size=100 if g == "small" else 4000))]
    rows = spark.createDataFrame(data, "target string, pos long, score double")
    cuts = group_cuts(rows, ["target"], 200)
    assert {r.target: len(r.cuts) for r in cuts.collect()} == {"a": 19, "b": 19, "c": 19}
    placed = add_bucket(rows, ["target"], cuts)
    sizes = {(r.target, r._bucket): r["count"] for r in placed.groupBy("target", "_bucket").count().collect()}
    assert sum(g == "small" for g, _ in sizes) == 1 and len(sizes) == 61
    assert max(n for (g, _), n in sizes.items() if g != "small") < 300  # one list for all groups would put 4000 into one bucket
    held = {r.target: r.cuts for r in cuts.collect()}
    for r in placed.collect():
        assert r._bucket == sum(c > r.score for c in held.get(r.target, []))


def test_boundary_buckets_stay_small(spark, table):
    scaled = table.withColumn("score", F.when(F.col("target") == "cold", F.col("score") * 2.0 ** 40).otherwise(F.col("score")))
    work = worklist(scaled, everybody(), rows_per_task=100)
    assert work.hist.where("target = 'cold'").count() > 1
    most = {r.target: r.rows for r in work.hist.groupBy("target").agg(F.max("rows").alias("rows")).collect()}
    tied = scaled.where("target = 'cold'").groupBy("score").count().agg(F.max("count")).first()[0]
    assert most["cold"] <= tied + 110  # scores that tie share a bucket
    same(kth_of(work, FRACTIONS), kth_score(scaled, FRACTIONS))


def test_no_group_is_large(spark):
    rows = spark.createDataFrame([(str(k % 50), k, float(k)) for k in range(500)], "target string, pos long, score double")
    assert group_cuts(rows, ["target"], 100) is None
    assert add_bucket(rows, ["target"], None).where("_bucket != 0").count() == 0


# --- The clustered layout -----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def stored(spark, table, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('clustered')}/p"
    clustered.write_clustered(table, everybody(), path, rows_per_file=100)
    return clustered.open_clustered(spark, path, rows_per_task=100)


def test_stored_population_answers_like_the_whole(table, stored):
    whole = worklist(table, everybody())
    same(stored.totals, whole.totals)
    same(decompose.four_cells(stored), decompose.four_cells(whole))
    cuts = kth_of(whole, FRACTIONS)
    same(kth_of(stored, FRACTIONS), cuts)
    same(selection.protocol_rows(stored, cuts), selection.protocol_rows(whole, cuts))
    same(selection.transport(stored, cuts), selection.transport(whole, cuts))
    high = cuts.withColumn("threshold", F.lit(1e9))
    same(selection.threshold_counts(stored, high), selection.threshold_counts(whole, high))
    asked = whole.totals.select("target", F.lit(EARLY).alias("scenario"), F.lit(9).cast("long").alias("budget_n"))
    same(selection.select_top(stored.rows, stored, asked), selection.select_top(whole.rows, whole, asked))


def test_slices_are_stretches_of_the_ranking(stored):
    hist = sorted(stored.hist.collect(), key=lambda r: (r.target, r._bucket))
    assert len(hist) > 25 and max(r.rows for r in hist) < 250  # the score that a third of all rows share is cut by position
    for a, b in zip(hist, hist[1:]):
        assert a.target != b.target or a.low >= b.high


def files(df):
    """Files of stored rows that the scans of a query have read."""
    df.collect()

    def scans(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(node.plan())
        if kind == "FileSourceScanExec" and "/rows" in node.relation().location().rootPaths().mkString():
            return node.metrics().apply("numFiles").value()
        children = node.children()
        return sum(scans(children.apply(k)) for k in range(children.size()))

    return scans(df._jdf.queryExecution().executedPlan())


def test_only_boundary_files_are_read(stored):
    asked = stored.totals.select("target", F.lit(ALL).alias("scenario"), F.lit(30).cast("long").alias("budget_n"))
    wanted = stored.hist.where("_bucket = 3").select("target", "_bucket")
    read = stored.of_buckets(wanted)
    assert files(read) == 1 < files(stored.rows)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert top_b(stored, asked).count() == 2


def test_a_stored_population_is_not_overwritten(spark, table, tmp_path):
    clustered.write_clustered(table, everybody(), f"{tmp_path}/p")
    with pytest.raises(FileExistsError):
        clustered.write_clustered(table, everybody(), f"{tmp_path}/p")


def test_weights_and_empty_population(spark, table, tmp_path):
    weighted = table.withColumn("w", (F.col("pos") % 4).cast("int"))
    clustered.write_clustered(weighted, scenarios(), f"{tmp_path}/w", weight="w", rows_per_file=150)
    whole, kept = worklist(weighted, scenarios(), weight="w"), clustered.open_clustered(spark, f"{tmp_path}/w")
    asked = whole.totals.select("target", F.lit(EARLY).alias("scenario"), F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 7, 40)])).alias("budget_n"))
    same(top_b(kept, asked).drop("last_score", "last_pos"), top_b(whole, asked).drop("last_score", "last_pos"))
    cuts = asked.select("target", F.lit(0.05).alias("nominal_fraction"), F.lit(0.5).alias("threshold")).distinct()
    same(selection.threshold_counts(kept, cuts, (0.05,)), selection.threshold_counts(whole, cuts, (0.05,)))


# --- Periods --------------------------------------------------------------------------------------------------------

def test_bins_rise_with_the_score(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([[0.0, -0.0, 5e-324, 1.7e308], 2.0 ** np.arange(-60, 60), np.nextafter(2.0 ** np.arange(-60, 60), 0), np.exp(rng.normal(0, 30, 3000))])
    x = np.concatenate([x, -x])
    got = spark.createDataFrame([(float(v),) for v in x], "score double").select("score", clustered.score_bin(F.col("score")).alias("b")).collect()
    got = sorted((r.score, r.b) for r in got)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))
    ends = {}
    for s, b in got:
        if 1e-300 < s:
            ends.setdefault(b, []).append(s)
    assert all(max(v) / min(v) <= 1 + 1.01 / clustered.BINS for v in ends.values())


def test_periods_add_up(spark, table, tmp_path):
    path = f"{tmp_path}/store"
    part = {str(k): table.where(F.pmod(F.hash("pos"), F.lit(3)) == k) for k in range(3)}
    for name in ("0", "1"):
        clustered.append_period(part[name], everybody(), path, name, rows_per_file=300)
    two, whole = clustered.open_periods(spark, path, rows_per_task=100), worklist(part["0"].union(part["1"]), everybody())
    same(two.totals, whole.totals)
    same(kth_of(two, FRACTIONS), kth_of(whole, FRACTIONS))
    clustered.append_period(part["2"], everybody(), path, "2")
    three, every = clustered.open_periods(spark, path), worklist(table, everybody())
    cuts = kth_of(every, FRACTIONS)
    same(kth_of(three, FRACTIONS), cuts)
    same(selection.protocol_rows(three, cuts), selection.protocol_rows(every, cuts))
    last, alone = clustered.open_periods(spark, path, ["2"]), worklist(part["2"], everybody())
    same(selection.transport(last, cuts), selection.transport(alone, cuts))
    assert clustered.periods(spark, path) == ["0", "1", "2"]


def test_earlier_rows_are_read_in_the_boundary_bin_only(spark, table, tmp_path):
    path = f"{tmp_path}/store"
    for k in range(2):
        clustered.append_period(table.where(F.pmod("pos", F.lit(2)) == k), everybody(), path, str(k), rows_per_file=100)
    work = clustered.open_periods(spark, path)
    edge = work.hist.where("target = 'cold'").orderBy("_bucket").limit(1)
    read = work.of_buckets(edge)
    assert read.count() == edge.first().rows and files(read) <= 2 < files(work.rows)
    assert "PartitionFilters: [" in read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in (plan := read._jdf.queryExecution().executedPlan().toString()) and "EqualTo(_bucket," in plan or "In(_bucket" in plan


def test_a_period_is_added_once_and_whole(spark, table, tmp_path):
    path = f"{tmp_path}/store"
    clustered.append_period(table, everybody(), path, "0")
    with pytest.raises(FileExistsError):
        clustered.append_period(table, everybody(), path, "0")
    with pytest.raises(ValueError, match="other groups or scenarios"):
        clustered.append_period(table, scenarios(), path, "1")
    table.limit(5).withColumn("_band", F.lit(0)).write.partitionBy("_band").parquet(f"{path}/rows/period=1")  # a run that ended before its histogram
    assert clustered.periods(spark, path) == ["0"]
    assert clustered.open_periods(spark, path).rows.count() == table.count()
    with pytest.raises(ValueError, match="lacks one of the periods"):
        clustered.open_periods(spark, path, ["1"])
    clustered.append_period(table, everybody(), path, "1")
    assert clustered.open_periods(spark, path).rows.count() == 2 * table.count()
    assert math.isclose(clustered.open_periods(spark, path).totals.agg(F.sum("full_n")).first()[0], 2 * table.count())
