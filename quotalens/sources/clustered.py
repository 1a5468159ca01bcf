"""Scored populations stored in ranking order, and their histograms, so that a question reads a few files.

Two layouts, both read as a :class:`~quotalens.operators.ranking.Worklist`, so that every selection operator works on them:

* :func:`write_clustered` range partitions once by (group, score, position). A file is a slice of the ranking, a hot score is
  cut by position, and the histogram says which slice a budget or threshold falls into.
* :func:`append_period` adds one period to a store. Its histogram counts fixed score bins, so that periods are merged by adding
  up; no row of an earlier period is read until a boundary falls into its bin.

Rows are committed before their histogram, and a store is what its histograms name: half-written rows are never read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.operators.ranking import MOST_BUCKETS, Worklist, bucket_measures, rank_order, scored_rows, totals_of
from quotalens.session import ROWS_PER_TASK, materialize
from quotalens.sources.sinks import exists, write_run_record

#: Bins of a factor of two in the score (the width of a bin is at most 1 / BINS of its scores), and bins that share a directory.
BINS, BAND = 256, 64


def _measures(scenarios: int) -> list[Column]:
    return [*bucket_measures(scenarios), F.min("score").alias("low"), F.max("score").alias("high")]


def write_clustered(
    population: DataFrame, scenarios: Mapping[str, Column], path: str, by: Sequence[str] = ("target",), weight: str | None = None,
    rows_per_file: int = ROWS_PER_TASK,
) -> None:
    """Store a population in ranking order in a new folder, about ``rows_per_file`` rows a slice, ``MOST_BUCKETS`` slices at most."""
    spark, names = population.sparkSession, list(scenarios)
    if exists(spark, path):
        raise FileExistsError(path)
    rows = scored_rows(population, scenarios, by, weight)
    order = [*[F.col(c) for c in by], *rank_order()]
    slices = max(1, min(MOST_BUCKETS, math.ceil(rows.count() / rows_per_file)))
    placed = rows.repartitionByRange(slices, *order).withColumn("_bucket", F.spark_partition_id())
    placed.sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(f"{path}/rows")
    write_run_record(spark, f"{path}/layout", by=list(by), scenarios=names)
    spark.read.parquet(f"{path}/rows").groupBy(*by, "_bucket").agg(*_measures(len(names))).write.parquet(f"{path}/histogram")


def _layout(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    kept = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    return tuple(kept["by"]), tuple(kept["scenarios"])


def open_clustered(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> Worklist:
    """A stored population, ready for top-B and threshold questions."""
    by, names = _layout(spark, path)
    hist = spark.read.parquet(f"{path}/histogram")
    return Worklist(spark.read.parquet(f"{path}/rows"), by, names, totals_of(hist, by), hist, rows_per_task, stored=True)


def score_bin(score: Column) -> Column:
    """The fixed bin of a finite score, rising with it: power of two and the next bits. No data decide it, so bins of all periods agree."""
    size = F.abs(score)
    power = F.floor(F.log2(size)).cast("int")
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * BINS).cast("int")
    # The logarithm may be off by one beside a power of two.
    number = (power + 1100) * BINS + F.greatest(F.lit(-1), F.least(F.lit(BINS), part)) + 1
    return F.when(size == 0, 0).otherwise(F.when(score > 0, number).otherwise(-number)).cast("int")


def append_period(
    population: DataFrame, scenarios: Mapping[str, Column], path: str, period: str, by: Sequence[str] = ("target",), weight: str | None = None,
    rows_per_file: int = ROWS_PER_TASK,
) -> None:
    """Add a period to a store. Only its own rows are read; a period that is there already is refused."""
    spark, names = population.sparkSession, list(scenarios)
    rows_path, hist_path = f"{path}/rows/period={period}", f"{path}/histogram/period={period}"
    if exists(spark, hist_path):
        raise FileExistsError(hist_path)
    if not exists(spark, f"{path}/layout"):
        write_run_record(spark, f"{path}/layout", by=list(by), scenarios=names)
    elif _layout(spark, path) != (tuple(by), tuple(names)):
        raise ValueError("the store has other groups or scenarios")
    rows = scored_rows(population, scenarios, by, weight).withColumn("_bucket", -score_bin(F.col("score")))
    rows = rows.withColumn("_band", F.floor(F.col("_bucket") / BAND).cast("int"))
    order = [F.col("_band"), F.col("_bucket"), *[F.col(c) for c in by], *rank_order()]
    files = max(1, math.ceil(rows.count() / rows_per_file))
    # What a run left that was interrupted before its histogram is replaced.
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_band").parquet(rows_path)
    stored = spark.read.schema(rows.schema).parquet(rows_path)
    stored.groupBy(*by, "_bucket").agg(*_measures(len(names))).write.parquet(hist_path)


def periods(spark: SparkSession, path: str) -> list[str]:
    """Periods that are complete."""
    return sorted(r[0] for r in spark.read.parquet(f"{path}/histogram").select(F.col("period").cast("string")).distinct().collect())


def open_periods(spark: SparkSession, path: str, wanted: Sequence[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> Worklist:
    """Some periods of a store (default: all) as one population, from the sum of their histograms."""
    by, names = _layout(spark, path)
    wanted = periods(spark, path) if wanted is None else list(wanted)
    if not wanted or any(not exists(spark, f"{path}/histogram/period={p}") for p in wanted):
        raise ValueError(f"the store lacks one of the periods {wanted}")
    parts = spark.read.parquet(*[f"{path}/histogram/period={p}" for p in wanted])
    counts = [c for c in parts.columns if c not in (*by, "_bucket", "low", "high")]
    hist = materialize(parts.groupBy(*by, "_bucket").agg(
        *[F.sum(c).alias(c) for c in counts], F.min("low").alias("low"), F.max("high").alias("high")), "histogram")
    each = [spark.read.parquet(f"{path}/rows/period={p}") for p in wanted]
    rows = reduce(DataFrame.unionByName, each)
    return Worklist(rows, by, names, totals_of(hist, by), hist, rows_per_task, stored=True, band=BAND)
