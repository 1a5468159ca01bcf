"""Boosted trees on weighted cells against the same trees on plain rows."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quotalens.operators import scoring
from quotalens.operators.features import transform_features


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for k in range(6000):
        a, b, code = rng.randrange(9), rng.choice([None, 0.5, 2.0, 7.25]), rng.randrange(3)
        made.append((k, float(a), b, float(code), int(rng.random() < 0.1 + 0.07 * a + 0.2 * (code == 1) * (b == 2.0))))
    return spark.createDataFrame(made, "pos long, a double, b double, code double, y int").repartition(4).cache()


def seen_by_the_trees(monkeypatch):
    seen = []
    plain = scoring.GBTClassifier.fit
    monkeypatch.setattr(scoring.GBTClassifier, "fit", lambda self, df: seen.append((df.count(), df.rdd.getNumPartitions())) or plain(self, df))
    return seen


def test_a_round_passes_over_cells_in_as_many_tasks_as_they_need(spark, rows, monkeypatch):
    seen = seen_by_the_trees(monkeypatch)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        scoring.fit_score(rows, "t", ["a", "b"], "code", trees=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (cells, tasks), = seen
    assert cells <= 9 * 3 * 3 * 2 and tasks == 1


def test_scores_equal_those_of_trees_on_rows(rows):
    fitted = scoring.fit_score(rows, "t", ["a", "b"], "code", trees=8, depth=3)
    got = {r.pos: r.score for r in scoring.score(rows, fitted).select("pos", "score").collect()}
    matrix = transform_features(rows, fitted.params).select("pos", array_to_vector("features").alias("features"), F.col("y").cast("double").alias("label"))
    plain = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.05, minInstancesPerNode=100, seed=2026).fit(matrix)
    for r in plain.transform(matrix).select("pos", vector_to_array("probability")[1].alias("p")).collect():
        assert abs(got[r.pos] - r.p) < 1e-9


def test_many_values_are_cut_at_quantiles_and_kept_with_the_score(spark, folder):
    rows = spark.range(20_000).select(
        F.col("id").alias("pos"), (F.col("id") * 7919 % 20_011).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") * 7919 % 20_011 < 6000).cast("int").alias("y"))
    fitted = scoring.fit_score(rows, "t", ["a", "b"], trees=3)
    assert len(fitted.edges[0]) == scoring.BINS - 1 and fitted.edges[1] == ()
    scoring.save_score(fitted, spark, f"{folder}/score")
    again = scoring.load_score(spark, f"{folder}/score")
    assert (again.target, again.params, again.edges) == (fitted.target, fitted.params, fitted.edges)
    both = scoring.score(scoring.score(rows, fitted), again, "reloaded")
    assert both.where("score != reloaded or not score between 0 and 1").count() == 0
    assert both.agg(F.avg(F.when(F.col("a") < 5500, F.col("score")))).first()[0] > both.agg(F.avg(F.when(F.col("a") > 6500, F.col("score")))).first()[0]
