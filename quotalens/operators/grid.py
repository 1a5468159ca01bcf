"""Audits over a grid of conditions and their summaries over replicates.

A condition is a group (replicate, score quality, ...) crossed with availability sets. The sets of a group are
boolean columns of one worklist: each group is ordered once and every set reads its counts from that order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalens.functions.numeric import clamped_budget, ratio
from quotalens.names import AVAILABLE, FIXED_BUDGET, FIXED_THRESHOLD, POPULATION, TOP_FRACTION
from quotalens.operators.decompose import CELLS
from quotalens.operators.ranking import Worklist, at_most, each_fraction, top_b, worklist
from quotalens.operators.selection import threshold_counts
from quotalens.session import ROWS_PER_TASK, materialize


@dataclass(frozen=True)
class Availability:
    """One availability set: its condition labels and who belongs to it."""

    labels: Mapping[str, object]
    member: Column


def grid_worklist(
    population: DataFrame, sets: Mapping[str, Availability], by: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> Worklist:
    members = {name: s.member for name, s in sets.items()} | {POPULATION: F.lit(True)}
    return worklist(population, members, by, rows_per_task=rows_per_task)


def _labels(s: Availability) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in s.labels.items()]


def _sizes(work: Worklist, name: str) -> list[Column]:
    return [
        work.n(name).alias("available_n"), work.e(name).alias("available_event_n"),
        F.col("full_n").alias("full_population_n"), F.col("full_e").alias("full_population_event_n"),
    ]


def availability_table(work: Worklist, sets: Mapping[str, Availability]) -> DataFrame:
    """Size, events and ceiling of each availability set."""
    rows = F.array(*[F.struct(*_labels(s), *_sizes(work, name)) for name, s in sets.items()])
    return work.totals.select(*work.by, F.inline(rows)).select(
        *work.by, *next(iter(sets.values())).labels,
        F.col("available_n").alias("realized_available_n"),
        ratio(F.col("available_n"), F.col("full_population_n")).alias("realized_available_fraction"),
        "full_population_event_n", "available_event_n",
        ratio(F.col("available_event_n"), F.col("full_population_event_n")).alias("event_availability_ceiling"),
    )


def grid_cells(work: Worklist, sets: Mapping[str, Availability], fractions: Sequence[float]) -> DataFrame:
    """Four cells per condition and share. Budgets may be zero; a common budget above a set's size fails the query.

    Written down, because protocols and effects both read it and it is small next to the population.
    """
    usable = F.when(F.col("full_e") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("a group has no events")).cast("boolean"))
    rows = F.array(*[F.struct(*_labels(s), F.lit(name).alias("_set"), *_sizes(work, name)) for name, s in sets.items()])
    sized = work.totals.where(usable).select(*work.by, F.inline(rows)).select("*", each_fraction(fractions))
    q, own = F.col("nominal_fraction"), F.col("available_n")
    budgets = sized.withColumns({
        "_own": clamped_budget(q, own), "_whole": at_most(clamped_budget(q, F.col("full_population_n")), own, "common budget")
    })
    cells = F.array(*[
        F.struct(
            F.lit(cell).alias("cell"), (F.lit(POPULATION) if from_wide else F.col("_set")).alias("scenario"),
            F.col("_whole" if by_wide else "_own").alias("budget_n"))
        for cell, (from_wide, by_wide) in CELLS.items()
    ])
    requests = budgets.select("*", F.inline(cells)).drop("_set", "_own", "_whole")
    return materialize(top_b(work, requests, allow_zero=True).drop("last_score", "last_pos"), "cells")


def grid_thresholds(
    calibration: DataFrame, by: Sequence[str], fractions: Sequence[float], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Cutoff per group and share on an independent sample: plus infinity for no selection, minus infinity for all."""
    work = worklist(calibration, {POPULATION: F.lit(True)}, by, rows_per_task=rows_per_task)
    requests = work.totals.select(*by, F.lit(POPULATION).alias("scenario"), "full_n", each_fraction(fractions)).withColumn(
        "budget_n", clamped_budget(F.col("nominal_fraction"), F.col("full_n")))
    infinite = F.lit(float("inf"))
    cut = F.when(F.col("budget_n") <= 0, infinite).when(F.col("budget_n") >= F.col("full_n"), -infinite).otherwise(F.col("last_score"))
    return top_b(work, requests, allow_zero=True).select(
        *by, "nominal_fraction", cut.alias("threshold"), F.col("budget_n").alias("calibration_target_selected_n"))


def grid_protocols(
    work: Worklist, sets: Mapping[str, Availability], cells: DataFrame, thresholds: DataFrame, fractions: Sequence[float]
) -> DataFrame:
    """Three protocols for the available subset and for everybody, per condition and share.

    ``thresholds``: by, ``nominal_fraction``, ``threshold``; an infinite threshold selects nobody or everybody.
    """
    labels = list(next(iter(sets.values())).labels)
    keys = [*work.by, *labels, "nominal_fraction"]
    everybody = F.col("scenario") == POPULATION
    sized = cells.select(
        *keys, "cell", F.when(everybody, POPULATION).otherwise(AVAILABLE).alias("scenario"), "full_population_n", "full_population_event_n",
        F.when(everybody, F.col("full_population_n")).otherwise(F.col("available_n")).alias("eligible_n"),
        F.when(everybody, F.col("full_population_event_n")).otherwise(F.col("available_event_n")).alias("eligible_event_n"),
        F.col("budget_n").alias("selected_n"), "true_positive_n", F.lit(None).cast("double").alias("threshold"),
    )
    # The subset's own share is C00 and its common budget C01; for everybody both protocols are C11.
    uses = F.when(F.col("cell") == "C00", F.array(F.lit(TOP_FRACTION))).when(
        F.col("cell") == "C01", F.array(F.lit(FIXED_BUDGET))).when(
        F.col("cell") == "C11", F.array(F.lit(TOP_FRACTION), F.lit(FIXED_BUDGET)))
    ranked_rows = sized.withColumn("protocol", F.explode(uses)).drop("cell")

    counted = threshold_counts(work, thresholds, fractions)
    whole = work.totals.select(*work.by, F.inline(F.array(*[
        F.struct(*_labels(s), F.lit(name).alias("_set"), *_sizes(work, name)) for name, s in sets.items()
    ])))
    cut_rows = []
    for everyone in (False, True):
        mine = counted.where(everybody) if everyone else counted.where(~everybody).withColumnRenamed("scenario", "_set")
        joined = whole.join(mine.drop("scenario"), list(work.by)) if everyone else whole.join(mine, [*work.by, "_set"])
        prefix = "full_population" if everyone else "available"
        cut_rows.append(joined.select(
            *keys, F.lit(POPULATION if everyone else AVAILABLE).alias("scenario"), "full_population_n", "full_population_event_n",
            F.col(f"{prefix}_n").alias("eligible_n"), F.col(f"{prefix}_event_n").alias("eligible_event_n"),
            "selected_n", "true_positive_n", "threshold", F.lit(FIXED_THRESHOLD).alias("protocol"),
        ))
    rows = ranked_rows.unionByName(cut_rows[0]).unionByName(cut_rows[1])
    return rows.select(
        *keys, "protocol", "scenario", "threshold", "full_population_n", "full_population_event_n", "eligible_n", "eligible_event_n",
        ratio(F.col("eligible_n"), F.col("full_population_n")).alias("eligible_fraction"), "selected_n", "true_positive_n",
        ratio(F.col("true_positive_n"), F.col("selected_n")).alias("precision"),
        ratio(F.col("true_positive_n"), F.col("eligible_event_n")).alias("recall_among_eligible"),
        ratio(F.col("true_positive_n"), F.col("full_population_event_n")).alias("population_event_capture"),
        ratio(F.col("eligible_event_n"), F.col("full_population_event_n")).alias("event_availability_ceiling"),
    )


def grid_comparisons(protocols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Available subset against everybody per condition, share and protocol."""
    measured = ("eligible_n", "selected_n", "true_positive_n", "population_event_capture")
    packed = F.struct(*measured)
    wide = protocols.groupBy(*keys, "protocol").agg(
        F.max(F.when(F.col("scenario") == AVAILABLE, packed)).alias("a"),
        F.max(F.when(F.col("scenario") == POPULATION, packed)).alias("b"), F.max("threshold").alias("threshold"),
    )
    out = []
    for m in measured:
        out += [F.col(f"a.{m}").alias(f"from_{m}"), F.col(f"b.{m}").alias(f"to_{m}")]
        if m != "eligible_n":
            out.append((F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"delta_{m}"))
    return wide.select(*keys, "protocol", F.lit(AVAILABLE).alias("from_scenario"), F.lit(POPULATION).alias("to_scenario"), *out, "threshold")


#: Effects of a condition in terms of the four captures.
GRID_EFFECTS = {
    "naive_top_fraction_effect": "c11 - c00",
    "availability_effect_at_all_budget": "c11 - c01",
    "capacity_effect_within_available_subset": "c01 - c00",
    "availability_main_effect": "c10 - c00",
    "capacity_main_effect": "c01 - c00",
    "distortion_top_fraction_minus_fixed_budget": "(c11 - c00) - (c11 - c01)",
    "shapley_availability_effect": "0.5D * ((c10 - c00) + (c11 - c01))",
    "shapley_capacity_effect": "0.5D * ((c01 - c00) + (c11 - c10))",
    "interaction_effect": "c11 - c10 - c01 + c00",
    "total_four_cell_effect": "c11 - c00",
}

#: Residuals of the identities, on captures and on true positives.
GRID_RESIDUALS = {
    "identity_error": "naive_top_fraction_effect - availability_effect_at_all_budget - capacity_effect_within_available_subset",
    "factorial_identity_error": "total_four_cell_effect - availability_main_effect - capacity_main_effect - interaction_effect",
    "shapley_identity_error": "total_four_cell_effect - shapley_availability_effect - shapley_capacity_effect",
}

#: The same effects counted in true positives.
GRID_TP = {
    "naive_delta_true_positive_n": "t11 - t00",
    "availability_delta_true_positive_n": "t11 - t01",
    "capacity_delta_true_positive_n": "t01 - t00",
    "availability_main_delta_true_positive_n": "t10 - t00",
    "capacity_main_delta_true_positive_n": "t01 - t00",
    "tp_interaction_n": "t11 - t10 - t01 + t00",
    "tp_factorial_identity_error": "(t11 - t00) - (t10 - t00) - (t01 - t00) - (t11 - t10 - t01 + t00)",
    "tp_identity_error": "(t11 - t00) - (t11 - t01) - (t01 - t00)",
}


def grid_effects(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per condition, share and replicate: sizes, budgets, captures, effects and residuals."""
    def at(cell: str, column: str) -> Column:
        return F.max(F.when(F.col("cell") == cell, F.col(column)))

    wide = cells.groupBy(*keys).agg(
        F.max("available_n").alias("realized_available_n"), F.max("available_event_n").alias("available_event_n"),
        F.max("full_population_n").alias("full_population_n"), F.max("full_population_event_n").alias("full_population_event_n"),
        at("C00", "budget_n").alias("budget_available_top_fraction"), at("C11", "budget_n").alias("budget_all_top_fraction"),
        *[at(c, "true_positive_n").alias(c.lower().replace("c", "t")) for c in CELLS],
    ).withColumns({
        "realized_available_fraction": ratio(F.col("realized_available_n"), F.col("full_population_n")),
        "event_availability_ceiling": ratio(F.col("available_event_n"), F.col("full_population_event_n")),
        **{c.lower(): ratio(F.col(c.lower().replace("c", "t")), F.col("full_population_event_n")) for c in CELLS},
    })
    full = wide.withColumns({n: F.expr(e) for n, e in {**GRID_EFFECTS, **GRID_TP}.items()}).withColumns(
        {n: F.expr(e) for n, e in GRID_RESIDUALS.items()})
    return full.withColumnsRenamed({c.lower(): f"{c.lower()}_capture" for c in CELLS}).drop(*[c.lower().replace("c", "t") for c in CELLS])


def _statistics(column: str) -> list[Column]:
    value = F.col(column).cast("double")
    return [
        F.avg(value).alias(f"mean_{column}"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"sd_{column}"),
        F.percentile(value, 0.025).alias(f"q025_{column}"), F.percentile(value, 0.975).alias(f"q975_{column}"),
    ]


def comparison_summary(comparisons: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Mean, sd (zero for one replicate) and 2.5 / 97.5 % points of the three deltas per condition and protocol."""
    measures = ("delta_population_event_capture", "delta_selected_n", "delta_true_positive_n")
    stats = [s for m in measures for s in _statistics(m)]
    return comparisons.groupBy(*conditions, "protocol").agg(*stats, F.count(F.lit(1)).alias("replicates"))


#: Measures summarised per condition.
SUMMARISED = (
    "realized_available_fraction", "event_availability_ceiling", "naive_top_fraction_effect", "availability_effect_at_all_budget",
    "capacity_effect_within_available_subset", "availability_main_effect", "capacity_main_effect",
    "distortion_top_fraction_minus_fixed_budget", "shapley_availability_effect", "shapley_capacity_effect", "interaction_effect",
    "total_four_cell_effect", "naive_delta_true_positive_n", "availability_delta_true_positive_n", "capacity_delta_true_positive_n",
)


def _opposite(a: Column, b: Column) -> Column:
    return (F.signum(a) != F.signum(b)) & (a != 0) & (b != 0)


def effect_summary(effects: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Statistics of every measure per condition, sign reversal and interval flags, largest residuals."""
    naive, fixed = F.col("naive_top_fraction_effect"), F.col("availability_effect_at_all_budget")
    out = effects.groupBy(*conditions).agg(
        *[s for m in SUMMARISED for s in _statistics(m)],
        F.count(F.lit(1)).alias("replicates"),
        F.avg(_opposite(naive, fixed).cast("double")).alias("sign_reversal_replicate_fraction"),
        F.max(F.abs("interaction_effect")).alias("max_abs_interaction_replicate"),
        F.avg(F.abs("interaction_effect")).alias("mean_abs_interaction"),
        F.max(F.abs("identity_error")).alias("max_abs_identity_error"),
        F.max(F.abs("tp_identity_error")).alias("max_abs_tp_identity_error"),
        F.max(F.abs("factorial_identity_error")).alias("max_abs_factorial_identity_error"),
        F.max(F.abs("shapley_identity_error")).alias("max_abs_shapley_identity_error"),
    )
    return out.withColumns({
        "naive_fixed_budget_sign_reversal": _opposite(
            F.col("mean_naive_top_fraction_effect"), F.col("mean_availability_effect_at_all_budget")),
        "fixed_budget_interval_below_zero": F.col("q975_availability_effect_at_all_budget") < 0,
        "fixed_budget_interval_above_zero": F.col("q025_availability_effect_at_all_budget") > 0,
        "shapley_availability_interval_below_zero": F.col("q975_shapley_availability_effect") < 0,
        "shapley_capacity_interval_below_zero": F.col("q975_shapley_capacity_effect") < 0,
        "interaction_interval_below_zero": F.col("q975_interaction_effect") < 0,
        "interaction_interval_above_zero": F.col("q025_interaction_effect") > 0,
    })


#: Flags carried by the condition table.
FLAGS = (
    "naive_fixed_budget_sign_reversal", "sign_reversal_replicate_fraction", "fixed_budget_interval_below_zero",
    "fixed_budget_interval_above_zero", "shapley_availability_interval_below_zero", "shapley_capacity_interval_below_zero",
    "interaction_interval_below_zero", "interaction_interval_above_zero", "max_abs_interaction_replicate",
)

#: Effects shown in the condition table with mean and interval.
TABLED = (
    "naive_top_fraction_effect", "availability_effect_at_all_budget", "availability_main_effect", "capacity_main_effect",
    "shapley_availability_effect", "shapley_capacity_effect", "interaction_effect", "distortion_top_fraction_minus_fixed_budget",
)


def condition_table(summary: DataFrame, conditions: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The summary's report columns, sorted and numbered from 1. One row per condition, so one window task is enough."""
    shown = [c for e in TABLED for c in (f"mean_{e}", f"q025_{e}", f"q975_{e}")]
    numbered = F.row_number().over(Window.orderBy(*order)).alias("condition_id")
    return summary.select(numbered, *conditions, *shown, *FLAGS)


def sign_reversals(table: DataFrame) -> DataFrame:
    """Conditions in which the naive and the fixed-budget effect point in opposite directions."""
    return table.where("naive_fixed_budget_sign_reversal")


def intervals_below_zero(table: DataFrame) -> DataFrame:
    """Conditions with at least one interval entirely below zero."""
    return table.where(
        "fixed_budget_interval_below_zero OR shapley_availability_interval_below_zero "
        "OR shapley_capacity_interval_below_zero OR interaction_interval_below_zero"
    )
