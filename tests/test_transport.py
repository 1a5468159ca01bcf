"""A threshold on arriving scores: late rows, restarts and replays against plain counting; and the audit through SQL functions."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotalens.names import ALL, EARLY, FRACTIONS
from quotalens.operators import decompose
from quotalens.operators.cohorts import scenarios
from quotalens.operators.ranking import worklist
from quotalens.plans.sql_surface import register_audit
from quotalens.sources import clustered
from quotalens.streaming.transport import window_workload, write_windows
from test_clustered import rows_of, same
from test_ranking import population

SCHEMA = "target string, pos long, ts timestamp_ntz, score double, y int"
START = dt.datetime(2024, 3, 1)


def rows(days, n=40, first=0):
    out = []
    for day in days:
        for k in range(n):
            at = START + dt.timedelta(days=day, minutes=31 * k)
            out.append(("ab"[k % 2], first + 1000 * day + k, at, float((k * 7 + day) % 20), int(k % 3 == 0)))
    return out


CUTS = [("a", 0.05, 15.0), ("a", 0.1, 12.0), ("b", 0.05, 18.0), ("b", 0.1, 3.0)]


def plain(data):
    groups = defaultdict(list)
    for target, _, ts, score, y in data:
        groups[target, ts.date()].append((score, y))
    return {(target, day, q): (len(g), sum(y for _, y in g), sum(s >= t for s, _ in g), sum(y for s, y in g if s >= t))
            for (target, day), g in groups.items() for name, q, t in CUTS if name == target}


def counted(df):
    return {(r.target, r.window_start.date(), r.nominal_fraction): (r.N_all, r.E_all, r.selected_n, r.TP) for r in df.collect()}


@pytest.fixture()
def cuts(spark):
    return spark.createDataFrame(CUTS, "target string, nominal_fraction double, threshold double")


def arrive(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, cuts, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = write_windows(window_workload(stream, cuts, **options), f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    return counted(spark.read.schema(query_schema(spark, cuts)).parquet(f"{folder}/out"))


def query_schema(spark, cuts):
    return window_workload(spark.createDataFrame([], SCHEMA), cuts).schema


def test_batch_equals_plain_counting(spark, cuts):
    data = rows(range(4))
    got = window_workload(spark.createDataFrame(data, SCHEMA), cuts)
    assert counted(got) == plain(data)
    for r in got.collect():
        assert r.workload_difference_n == r.selected_n - max(1, round(r.nominal_fraction * r.N_all)) and r.prevalence == r.E_all / r.N_all


def test_restarts_and_late_rows(spark, folder, cuts):
    """Days arrive in three runs; rows that are late but in time count, rows behind the watermark don't; no window comes twice."""
    first, second = rows(range(0, 4)), rows(range(4, 8)) + rows([3], first=500)  # day 3 is still open when more of it arrives
    lost = rows([0], first=700)  # day 0 was closed by day 3 and a delay of two days... and by day 7 for certain
    arrive(spark, folder, first)
    one = run(spark, folder, cuts)
    newest = max(r[2] for r in first)
    assert one == {k: v for k, v in plain(first).items() if dt.datetime.combine(k[1], dt.time()) + dt.timedelta(days=1) <= newest - dt.timedelta(days=2)} != {}
    arrive(spark, folder, second)
    two = run(spark, folder, cuts)
    assert one.items() <= two.items()
    arrive(spark, folder, lost + rows(range(8, 12)))
    three = run(spark, folder, cuts)
    whole = first + second + rows(range(8, 12))
    newest = max(r[2] for r in whole)
    assert three == {k: v for k, v in plain(whole).items() if dt.datetime.combine(k[1], dt.time()) + dt.timedelta(days=1) <= newest - dt.timedelta(days=2)}
    assert run(spark, folder, cuts) == three  # nothing new arrived


def test_replayed_records_count_once(spark, folder, cuts):
    data = rows(range(6))
    arrive(spark, folder, data[:120] + data[60:120])
    run(spark, folder, cuts, unique=["target", "pos"])
    arrive(spark, folder, data[100:])
    got = run(spark, folder, cuts, unique=["target", "pos"])
    expected = plain(data)
    assert got and all(expected[k] == v for k, v in got.items())
    again = window_workload(spark.createDataFrame(data + data[:50], SCHEMA), cuts, unique=["target", "pos"])
    assert counted(again) == expected


def test_a_bad_score_fails_the_stream(spark, folder, cuts):
    arrive(spark, folder, [("a", 1, START, float("nan"), 0)])
    with pytest.raises(Exception, match="not finite"):
        run(spark, folder, cuts)


# --- SQL functions ------------------------------------------------------------------------------------------------------

def test_sql_functions_equal_the_operators(spark, tmp_path):
    table = rows_of(spark, population(1500)).cache()
    clustered.write_clustered(table, scenarios(), f"{tmp_path}/p", rows_per_file=100)
    register_audit(spark, clustered.open_clustered(spark, f"{tmp_path}/p"), "t1")
    fractions = (0.013, 0.05, 0.2)
    union = " UNION ALL ".join(f"SELECT * FROM t1_decomposition({q})" for q in fractions)
    cells = decompose.four_cells(worklist(table, scenarios()), fractions)
    same(spark.sql(union), decompose.decomposition(cells))
    mine = spark.sql(" UNION ALL ".join(f"SELECT * FROM t1_cells({q})" for q in fractions))
    same(mine, cells.select(*mine.columns))
    flow = {(r.target, r.scenario): (r.n, r.e) for r in spark.sql("SELECT * FROM t1_flow()").collect()}
    early = table.where(scenarios()[EARLY]).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("e")).collect()
    assert {r.target: (r.n, r.e) for r in early} == {t: v for (t, s), v in flow.items() if s == EARLY} and ("hot", ALL) in flow
    plan = spark.sql(union)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    picked = spark.sql("SELECT t.target, t.true_positive_n FROM t1_top(0.05) t JOIN t1_flow() f USING (target, scenario) WHERE budget_of = 'own' AND n > 10")
    assert picked.count() == 6


def test_sql_functions_need_a_stored_population(spark):
    table = rows_of(spark, population(50))
    with pytest.raises(ValueError, match="stored population"):
        register_audit(spark, worklist(table, scenarios()))
    assert FRACTIONS
