"""Fitting a score per target on training rows, batch scoring, and cutoffs on calibration rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.names import FRACTIONS
from quotalens.operators.features import ACCURACY, FeatureParameters, check_features, fit_features, transform_features
from quotalens.operators.ranking import kth_score, ranked
from quotalens.session import ROWS_PER_TASK, materialize, shared_folder

#: Bins of a numeric feature at most, and cells of one task in a boosting round. A round is a handful of short stages, so
#: its tasks follow the size of the matrix and never the session's shuffle width.
BINS, CELLS_PER_TASK = 32, 50_000


@dataclass(frozen=True)
class FittedScore:
    """A score for one target: frozen feature parameters, upper ends of the bins of each numeric one, and a boosted-tree model."""

    target: str
    params: FeatureParameters
    edges: tuple[tuple[float, ...], ...]
    model: GBTClassificationModel


def bin_edges(matrix: DataFrame, numeric_n: int, bins: int = BINS) -> tuple[tuple[float, ...], ...]:
    """Upper ends of the bins of the first ``numeric_n`` features, the last bin left open, in two scans.

    A feature of at most ``bins`` distinct values gets a bin for each; others are cut at quantiles.
    """
    columns = [F.col("features")[i].alias(f"f{i}") for i in range(numeric_n)]
    numbers = matrix.select(*columns)
    shares = [k / bins for k in range(1, bins)]
    row = numbers.agg(*[m for i in range(numeric_n) for m in (
        F.approx_count_distinct(f"f{i}").alias(f"n{i}"), F.percentile_approx(f"f{i}", shares, ACCURACY).alias(f"q{i}"))]).first()
    few = [i for i in range(numeric_n) if row[f"n{i}"] <= 2 * bins]  # the estimate is never that far off
    seen = numbers.agg(*[F.sort_array(F.collect_set(f"f{i}")).alias(f"v{i}") for i in few]).first() if few else None
    whole = {i: seen[f"v{i}"][:-1] for i in few if len(seen[f"v{i}"]) <= bins}
    return tuple(tuple(sorted(set(whole.get(i, row[f"q{i}"])))) for i in range(numeric_n))


def binned(features: str, edges: Sequence[Sequence[float]], size: int) -> Column:
    """The assembled array with each numeric feature replaced by the number of its bin."""
    places = [
        sum(((F.col(features)[i] > F.lit(end)).cast("float") for end in ends), F.lit(0.0).cast("float")) for i, ends in enumerate(edges)
    ]
    return F.concat(F.array(*places), F.slice(features, len(edges) + 1, size))


def fit_score(
    train: DataFrame, target: str, numeric: Sequence[str], category: str | None = None, label: str = "y",
    trees: int = 350, depth: int = 5, step: float = 0.05, min_rows: int = 100, seed: int = 2026,
) -> FittedScore:
    """Fit on training rows of the target's population only; nothing is read from any other rows.

    Boosted trees grown level by level (32 leaves at depth 5), no class weights. Feature parameters come from the same
    training rows. Trees see numeric features by their bins, so rows that agree in all bins and the label are one cell with
    their number as weight: a round passes over cells, of which there are no more than combinations of bins. ``min_rows``
    counts rows, not cells.
    """
    used = [*numeric, *([category] if category else [])]
    check_features(used)
    train = materialize(train.select(*used, label), "train")  # fitting scans them some ten times
    params = fit_features(train, numeric, category)
    rows = transform_features(train, params).select("features", F.col(label).cast("double").alias("label"))
    edges = bin_edges(rows, len(params.numeric))
    cells = rows.select(binned("features", edges, len(params.columns)).alias("features"), "label").groupBy("features", "label").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    cells = materialize(cells, "cells")
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows")).first()
    matrix = cells.select(array_to_vector("features").alias("features"), "label", "weight")
    # Every boosting round passes over the same cells, so an even spread pays for its one shuffle.
    matrix = matrix.repartition(max(1, -(-size["n"] // CELLS_PER_TASK)))
    _cut_lineage(train.sparkSession)
    model = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=step, maxBins=BINS, minInstancesPerNode=1, weightCol="weight",
        minWeightFractionPerNode=min(min_rows / (size["rows"] or 1.0), 0.4999), seed=seed, cacheNodeIds=False,
    ).fit(matrix)
    return FittedScore(target, params, edges, model)


def _cut_lineage(spark: SparkSession) -> None:
    """Boosting cuts the lineage of its rounds only if there is a folder for it; hundreds of rounds need that."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def score(df: DataFrame, fitted: FittedScore, output: str = "score") -> DataFrame:
    """Probability of the event as double. Filter before scoring: only the rows given are transformed."""
    ready = transform_features(df, fitted.params, "_array").withColumn(
        "features", array_to_vector(binned("_array", fitted.edges, len(fitted.params.columns))))
    return fitted.model.transform(ready).withColumn(output, vector_to_array("probability")[1]).drop(
        "_array", "features", "rawPrediction", "probability", "prediction")


def save_score(fitted: FittedScore, spark: SparkSession, folder: str) -> None:
    """Model and feature parameters in ``folder``, which must not exist; later periods are scored with what is loaded."""
    fitted.model.write().save(f"{folder}/model")
    kept = [(fitted.target, fitted.params.to_json(), json.dumps(fitted.edges))]
    spark.createDataFrame(kept, "target string, params string, edges string").coalesce(1).write.mode("errorifexists").json(f"{folder}/params")


def load_score(spark: SparkSession, folder: str) -> FittedScore:
    kept = spark.read.schema("target string, params string, edges string").json(f"{folder}/params").first()
    edges = tuple(tuple(ends) for ends in json.loads(kept["edges"]))
    return FittedScore(kept["target"], FeatureParameters.from_json(kept["params"]), edges, GBTClassificationModel.load(f"{folder}/model"))


def calibration_cutoffs(
    scored: DataFrame, year: int, fractions: Sequence[float] = FRACTIONS, by: Sequence[str] = ("target",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Cutoff per target and share on scored calibration rows, with its provenance."""
    cut = kth_score(scored, fractions, by, rows_per_task)
    return cut.select(*by, "nominal_fraction", "threshold", F.lit(year).alias("source_year"), "calibration_n")


def rank_agreement(df: DataFrame, other: str, by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per group, how many records change place when ``other`` ranks them instead of ``score``.

    Zero for a recalibration with positive slope: ties stay ties and keep their position order. The first rank travels
    as a column into the second ranking, so the two are never joined.
    """
    by = list(by)
    first = ranked(df.select(*by, "pos", "score", "y", F.col(other).alias("_other")), by, rows_per_task=rows_per_task)
    again = first.select(*by, "pos", F.col("_other").alias("score"), "y", F.col("rank").alias("_rank_score"))
    second = ranked(materialize(again, "ranked-once"), by, rows_per_task=rows_per_task)
    return second.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_rank_score") != F.col("rank")).alias("moved_n"))
