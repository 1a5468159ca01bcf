"""Score diagnostics: prevalence, ROC AUC, average precision, Brier score, drift and skill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import ratio
from quotalens.operators.ranking import finite_score, running_totals, slices_for, worklist
from quotalens.operators.selection import threshold_counts
from quotalens.session import ROWS_PER_TASK, materialize


def model_diagnostics(
    population: DataFrame, by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """n, events, prevalence, average precision, ROC AUC and Brier score per group, exact under ties.

    Rows collapse to distinct scores first (map-side), so ties cost nothing and share one step of the curve. In a large
    population the distinct scores are cut into range slices with offsets, so no task holds a whole group however many
    there are.
    """
    by = list(by)
    scored = population.select(*by, finite_score().alias("score"), F.col("y").cast("int").alias("y"))
    error = (F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))
    steps = scored.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("e"), F.sum(error).alias("sq"),
    )
    slices = 0
    if scored.count() > rows_per_task:  # what is sliced are the steps, of which tied scores leave few
        steps = materialize(steps, "steps")
        slices = slices_for(steps.count(), rows_per_task)
    curve = running_totals(steps, by, [F.col("score").desc()], {"cum_n": F.col("n"), "cum_e": F.col("e")}, slices)
    negatives = F.col("n") - F.col("e")
    sums = curve.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("e").alias("event_n"), F.sum("sq").alias("sq"),
        # Each negative is beaten by the events above it and half beaten by the events that tie with it.
        F.sum(negatives.cast("double") * (F.col("cum_e") - F.col("e") / 2)).alias("wins"),
        F.sum(F.col("e") * ratio(F.col("cum_e"), F.col("cum_n"))).alias("gain"),
    )
    positives, others = F.col("event_n"), F.col("n") - F.col("event_n")
    return sums.select(
        *by, "n", "event_n", ratio(positives, F.col("n")).alias("prevalence"),
        F.try_divide(F.col("gain"), positives.cast("double")).alias("pr_auc"),
        F.try_divide(F.col("wins"), positives.cast("double") * others.cast("double")).alias("roc_auc"),
        F.try_divide(F.col("sq"), F.col("n").cast("double")).alias("brier"),
    )


def period_diagnostics(rows: DataFrame, period: str, by: Sequence[str] = ("target",), names: tuple[str, str] = ("calibration", "evaluation")) -> DataFrame:
    """Calibration and evaluation diagnostics side by side; ``period`` is the boolean calibration column."""
    long = model_diagnostics(rows, [*by, period])
    measures = ("n", "event_n", "prevalence", "pr_auc", "roc_auc", "brier")
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col(period) == flag, F.col(m))).alias(f"{name}_{m}")
        for name, flag in zip(names, (True, False)) for m in measures
    ])


def drift_and_skill(both: DataFrame, by: Sequence[str] = ("target",), names: tuple[str, str] = ("calibration", "evaluation")) -> DataFrame:
    """Absolute change of AUC and average precision between periods, and Brier skill against the prevalence."""
    old, new = names
    prevalence = F.col(f"{new}_prevalence")
    return both.select(
        *by, F.abs(F.col(f"{new}_roc_auc") - F.col(f"{old}_roc_auc")).alias("roc_auc_drift"),
        F.abs(F.col(f"{new}_pr_auc") - F.col(f"{old}_pr_auc")).alias("pr_auc_drift"),
        (F.lit(1.0) - F.try_divide(F.col(f"{new}_brier"), prevalence * (1 - prevalence))).alias("brier_skill"),
    )


def realized_with_ties(
    population: DataFrame, cutoffs: DataFrame, fractions: Sequence[float], by: Sequence[str] = ("target",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Cutoffs with the number of records that reach them; ties can push it above the nominal number."""
    work = worklist(population, {"everybody": F.lit(True)}, by, rows_per_task=rows_per_task)
    counted = threshold_counts(work, cutoffs, fractions).select(
        *by, "nominal_fraction", F.col("selected_n").alias("realized_selected_n_with_ties"))
    return cutoffs.join(counted, [*by, "nominal_fraction"])
