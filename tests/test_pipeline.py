"""Sources, features, fitting, the whole audit, the grid run and the stream."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalens.functions import cleaning
from quotalens.functions.numeric import platt
from quotalens.operators import checks, cohorts, features, scoring, selection
from quotalens.operators.features import FeatureParameters
from quotalens.plans import audit, bindings
from quotalens.plans.catalog import GRID_CONDITIONS, GRID_ORDER
from quotalens.sources import sinks, tables
from quotalens.streaming import harmonize as stream

TARGETS = ("a", "b", "c")
THRESHOLD_SCHEMA = "target string, nominal_fraction double, threshold double, source_year int, comparator string"


def thresholds(spark, change=None):
    rows = {(t, q): (t, q, 0.9 if q == 0.1 else 0.95, 2022, ">=") for t in TARGETS for q in (0.05, 0.1)}
    return spark.createDataFrame(list((change(rows) if change else rows).values()), THRESHOLD_SCHEMA)


def replay(spark, n=2000):
    entry = F.element_at(F.array(*[F.lit(v).cast("int") for v in (1, 2, 3, 4, 0, None)]), (F.col("id") % 6 + 1).cast("int"))
    rows = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") / n).alias("score"), entry.alias("entry"),
                                 *[(F.col("id") % (k + 4) == 0).cast("int").alias(t) for k, t in enumerate(TARGETS)])
    return cohorts.by_target(rows, TARGETS, ["pos", "score", "entry"])


def test_whole_audit(spark, folder):
    out = audit.frozen_score_audit(replay(spark), thresholds(spark), TARGETS, replicates=20)
    sizes = {k: v.count() for k, v in out.items()}
    assert (sizes["four_cells"], sizes["decomposition"], sizes["protocol_results"], sizes["threshold_transport"]) == (24, 6, 54, 12)
    assert (sizes["bootstrap_replicates"], sizes["protocol_comparisons"], sizes["summary"], sizes["cohort_counts"]) == (120, 54, 6, 18)
    assert sizes["protocol_bootstrap_replicates"] == 20 * 54
    for r in out["summary"].collect():
        assert r.shapley_capacity_lower <= r.shapley_capacity_upper
    sinks.write_results({"four_cells": out["four_cells"]}, folder, "csv")
    back = tables.read_csv(spark, f"{folder}/four_cells", ["target", "selected_n"], {"selected_n": "bigint"}, 24)
    assert back.agg(F.sum("selected_n")).first()[0] == out["four_cells"].agg(F.sum("selected_n")).first()[0]


def test_zero_total_has_no_share(spark):
    row = spark.createDataFrame([(0.0, 0.0)], "shapley_capacity double, total_topq_contrast double")
    from quotalens.operators.decompose import with_capacity_share
    assert with_capacity_share(row).first().capacity_share is None


@pytest.mark.parametrize("change", [
    lambda rows: {k: v for k, v in rows.items() if k[0] != "a"},
    lambda rows: rows | {"twice": rows["a", 0.05]},
    lambda rows: rows | {"x": ("x", 0.05, 0.5, 2022, ">=")},
    lambda rows: rows | {("a", 0.05): ("a", 0.2, 0.5, 2022, ">=")},
    *[lambda rows, v=v: rows | {("a", 0.05): ("a", 0.05, v, 2022, ">=")} for v in (float("nan"), float("inf"), -0.1, 1.1)],
    lambda rows: rows | {("a", 0.05): ("a", 0.05, 0.5, 2023, ">=")},
    lambda rows: rows | {("a", 0.05): ("a", 0.05, 0.5, 2022, ">")},
])
def test_bad_thresholds_are_refused(spark, change):
    assert tables.threshold_violations(thresholds(spark), TARGETS, (0.05, 0.1)).count() == 0
    with pytest.raises(ValueError, match="thresholds"):
        checks.require(tables.threshold_violations(thresholds(spark, change), TARGETS, (0.05, 0.1)), "thresholds")


def test_thresholds_keep_every_bit(spark, folder):
    values = [0.15552919096972664, float(np.nextafter(0.1, 1)), 0.1, float(np.nextafter(0.1, 0))]
    with open(f"{folder}/t.csv", "w") as f:
        f.write("target,nominal_fraction,threshold\n" + "".join(f"t{i},0.05,{v!r}\n" for i, v in enumerate(values)))
    got = tables.read_thresholds(spark, f"{folder}/t.csv")
    assert [r.threshold for r in got.orderBy("target").collect()] == values
    rows = spark.createDataFrame([(v,) for v in (float(np.nextafter(0.1, 0)), 0.1, float(np.nextafter(0.1, 1)))], "score double")
    assert [r.score for r in selection.threshold_select(rows, 0.1).collect()] == [0.1, float(np.nextafter(0.1, 1))]
    moved = got.withColumn("threshold", F.round("threshold", 6))
    assert tables.binding_violations(moved, got).count() == 3


def test_csv_locks(spark, folder):
    with open(f"{folder}/x.csv", "w") as f:
        f.write("a,b,c\n1,2,3\n4,5,6\n")
    assert tables.read_csv(spark, f"{folder}/x.csv", ["c", "a"], {"a": "int", "c": "int"}, 2).collect()[1] == (6, 4)
    for columns, rows in ((["d"], None), (["a"], 3)):
        with pytest.raises(ValueError):
            tables.read_csv(spark, f"{folder}/x.csv", columns, expected_rows=rows)


def test_file_locks(spark, folder):
    os.makedirs(f"{folder}/in/sub one")
    for name, text in (("in/part-0", "a\nb\n"), ("in/sub one/part-0", "c\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    lock = tables.file_fingerprints(spark, f"{folder}/in").collect()
    assert sorted((r.name, r.rows) for r in lock) == [("part-0", 2), ("sub one/part-0", 1)]
    frozen = spark.createDataFrame(lock, "name string, rows bigint, xor_hash bigint, sum_hash string")
    assert tables.manifest_violations(tables.file_fingerprints(spark, f"{folder}/in"), frozen).count() == 0
    assert [r.name for r in tables.file_fingerprints(spark, f"{folder}/in/part-0").collect()] == ["part-0"]
    with open(f"{folder}/in/part-0", "a") as f:
        f.write("b\n")
    assert [r.name for r in tables.manifest_violations(tables.file_fingerprints(spark, f"{folder}/in"), frozen).collect()] == ["part-0"]


def test_fingerprint_sees_duplicates_nulls_and_no_order(spark):
    def mark(rows):
        return tuple(tables.fingerprint(spark.createDataFrame(rows, "a int, b string"), ["a", "b"]).first())
    base = [(1, "x"), (2, None), (3, "")]
    assert mark(base) == mark(base[::-1])
    assert len({mark(base), mark([(1, "x"), (2, ""), (3, "")]), mark(base + [(4, "y"), (4, "y")]), mark(base + [(5, "z"), (5, "z")])}) == 4


def test_scores_export_and_refuse_overwrite(spark, folder):
    sinks.export_scores(replay(spark, 60), f"{folder}/scores")
    assert spark.read.parquet(f"{folder}/scores").where("target = 'a'").count() == 60
    with pytest.raises(Exception):
        sinks.export_scores(replay(spark, 60), f"{folder}/scores")
    sinks.write_schema(spark, f"{folder}/schema")
    assert spark.read.json(f"{folder}/schema/fields").count() == 34


def test_features_fit_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 7.0), (3.0, 7.0)], "x double, c double")
    p = features.fit_features(train, ["x"], "c")
    assert p.medians == (2.0,) and p.mode == 3.0 and p.categories == (3.0, 7.0)
    later = spark.createDataFrame([(1e8, 9.0), (None, None), (float("nan"), 7.0)], "x double, c double")
    rows = [list(r.features) for r in features.transform_features(later, p).collect()]
    assert rows[0][1:] == [0.0, 0.0] and rows[1][1:] == [1.0, 0.0] and rows[1][0] == 0.0 and rows[2] == [0.0, 0.0, 1.0]
    assert FeatureParameters.from_json(p.to_json()) == p
    with pytest.raises(Exception, match="infinite"):
        features.transform_features(spark.createDataFrame([(float("inf"), 3.0)], "x double, c double"), p).collect()
    with pytest.raises(TypeError):
        features.transform_features(spark.createDataFrame([(1.0, "01")], "x double, c string"), p)
    with pytest.raises(ValueError):
        features.transform_features(train.drop("x"), p)
    for bad in ({"scales": (0.0,)}, {"medians": (float("nan"),)}, {"mode": 5.0}, {"means": (1.0, 2.0)}):
        with pytest.raises(ValueError):
            FeatureParameters(**({"numeric": ("x",), "medians": (1.0,), "means": (1.0,), "scales": (1.0,), "category": "c", "mode": 3.0, "categories": (3.0,)} | bad))


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_exact_quantile(spark, rows_per_task):
    rng = np.random.default_rng(1)
    values = {"x": rng.normal(size=501), "z": np.round(rng.normal(size=501), 1)}
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(values["x"], values["z"])], "x double, z double")
    for p in (0.0, 0.3, 0.5, 1.0):
        got = {r.feature: r.quantile for r in features.exact_quantile(rows, ["x", "z"], p, rows_per_task).collect()}
        for c in values:
            assert got[c] == pytest.approx(np.quantile(values[c], p), abs=1e-12)


def test_platt_keeps_the_ranking(spark):
    rows = spark.createDataFrame([("t", i, s, 0) for i, s in enumerate([.3, .1, .3, .9, .7, .7])], "target string, pos int, score double, y int")
    assert scoring.rank_agreement(rows.withColumn("p", platt(F.col("score"), -0.7, 1.4, 1e-12)), "p").first().moved_n == 0
    assert scoring.rank_agreement(rows.withColumn("p", platt(F.col("score"), -0.7, -1.4, 1e-12)), "p").first().moved_n > 0
    with pytest.raises(Exception, match="NaN"):
        rows.withColumn("p", platt(F.lit(float("nan")), 0.0, 1.0, 1e-12)).collect()


def test_entry_and_binary_checks(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 11.0), (2, 2.5), (3, None)], "pos int, entry double")
    assert [r.pos for r in checks.entry_violations(rows).orderBy("pos").collect()] == [1, 2]
    assert not checks.entry_check(rows).first().valid
    groups = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 10, None)], "entry int").select(
        *[c.alias(n) for n, c in cohorts.flow_scenarios().items()]).collect()
    assert [i for i, r in enumerate(groups) if r.early_entry] == [1, 2, 3] and [i for i, r in enumerate(groups) if r.any_prenatal_care] == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(99,)], "entry int").select(cohorts.entry_group()).collect()


def test_fit_end_to_end(spark):
    rows = bindings.feature_records(spark, "/root/testdata/sf0.001").withColumnsRenamed({"y": "label_a", "entry": "prenatal_care_month"}).withColumns(
        {"is_us_resident": F.lit(1), "is_singleton": F.lit(1)}).drop("target")
    fitted, cuts = audit.fit(rows, ["label_a"], 2022, numeric=("acctbal", "price", "month"), category="nation", trees=3, depth=2, min_rows=5)
    assert sorted((r.target, r.nominal_fraction, r.source_year) for r in cuts.collect()) == [("label_a", 0.05, 2022), ("label_a", 0.1, 2022)]
    scored = audit.score_targets(audit.target_population(rows, ["label_a"], ["pos", "acctbal", "price", "month", "nation"]), fitted)
    assert checks.score_check(scored).first().valid


def test_grid_run(spark):
    folder = "/root/testdata/sf0.01"
    from quotalens.operators.grid import grid_thresholds
    cuts = grid_thresholds(bindings.grid_population(spark, folder, True), bindings.GRID_BY, bindings.GRID_FRACTIONS)
    out = audit.condition_grid(bindings.grid_population(spark, folder, False), bindings.grid_sets(), cuts, bindings.GRID_BY,
                               GRID_CONDITIONS, GRID_ORDER, bindings.GRID_FRACTIONS, rows_per_task=2000)
    sizes = {k: v.count() for k, v in out.items()}
    assert (sizes["protocol_results"], sizes["protocol_comparisons"], sizes["shapley_replicates"], sizes["condition_summary"]) == (1080, 540, 180, 36)
    assert [r.condition_id for r in out["condition_summary"].orderBy("condition_id").collect()] == list(range(1, 37))


def test_stream_equals_batch(spark, folder):
    lines = bindings.rendered_lines(spark, "/root/testdata/sf0.001")
    source = f"{folder}/in"
    lines.select("value").write.text(source)
    parsed = stream.harmonized_stream(stream.line_stream(spark, source, 3), 2022)
    query = stream.write_split(parsed, f"{folder}/ok", f"{folder}/bad", f"{folder}/check")
    query.awaitTermination()
    batch = cleaning.parse_strict(lines, 2022)
    columns = [c for c in batch.columns if c not in ("pos", "faults")]
    ours, theirs = (tables.fingerprint(df, columns).first() for df in (spark.read.parquet(f"{folder}/ok"), cleaning.accepted(batch)))
    assert ours == theirs
    assert spark.read.parquet(f"{folder}/bad").count() == cleaning.rejects(batch).count()


def test_run_scope_drops_its_tables(spark):
    from quotalens.session import materialize, run_scope, shared_folder
    from quotalens.sources.sinks import exists

    outside = shared_folder(spark)
    with run_scope(spark) as own:
        assert shared_folder(spark) == own and materialize(spark.range(10), "x").count() == 10 and exists(spark, own)
        with run_scope(spark) as inner:
            materialize(spark.range(3), "y")
        assert shared_folder(spark) == own and not exists(spark, inner)
    assert shared_folder(spark) == outside and not exists(spark, own)
