"""End-to-end runs: extraction, fitting, the frozen-score audit and the condition grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.functions import cleaning
from quotalens.functions.fields import FEATURES
from quotalens.names import FRACTIONS
from quotalens.operators import bootstrap, checks, cohorts, decompose, diagnostics, features, grid, scoring, selection
from quotalens.operators.ranking import worklist
from quotalens.session import ROWS_PER_TASK, materialize
from quotalens.sources import fixed_width, sinks, tables


def extract(
    spark: SparkSession, raw_path: str, year: int, destination: str, expected_rows: int,
    expected_fingerprint: Mapping[str, object] | None = None, lock: DataFrame | None = None,
) -> dict[str, object]:
    """Fixed-width text to a published table of 40 columns; any faulty record, count or content stops it.

    ``lock`` holds the frozen fingerprints of the input files (:func:`file_fingerprints`); a changed, missing or
    additional file stops it before anything is parsed. The text is parsed once, into a staging table.
    """
    if expected_rows <= 0:
        raise ValueError("expected row count must be positive")
    if sinks.exists(spark, destination):
        raise FileExistsError(destination)
    if lock is not None:
        checks.require(tables.manifest_violations(tables.file_fingerprints(spark, raw_path), lock), "input lock")
    parsed = materialize(cleaning.parse_strict(fixed_width.read_lines(spark, raw_path), year), "parsed")
    checks.require(cleaning.rejects(parsed), "rejected records")
    clean = cleaning.accepted(parsed)
    facts = sinks.publish(
        clean, f"{destination}", expected_rows, expected_fingerprint, [c for c in clean.columns if c != "pos"])
    record = {"status": "PASS", "year": year, "source_aliases": cleaning.source_names(year), **facts}
    sinks.write_run_record(spark, f"{destination}.record", **record)
    return record


def evaluation_table(spark: SparkSession, raw_path: str, destination: str) -> None:
    """The lenient 15-column evaluation table; an existing destination is refused."""
    lines = fixed_width.read_lines(spark, raw_path)
    cleaning.parse_lenient(lines).write.mode("errorifexists").parquet(destination)


def target_population(frame: DataFrame, targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Resident singleton records per target with a known label; the entry month becomes ``entry``."""
    primary = cohorts.primary_population(frame).withColumn("entry", F.col("prenatal_care_month").cast("int"))
    return cohorts.by_target(primary, targets, [*keep, "entry"])


def fit(
    records: DataFrame, targets: Sequence[str], year: int, seed: int = 2026, calibration_share: float = 0.2,
    numeric: Sequence[str] = FEATURES[1:], category: str | None = FEATURES[0], fractions: Sequence[float] = FRACTIONS,
    **model: object,
) -> tuple[dict[str, scoring.FittedScore], DataFrame]:
    """One score per target on training rows and its cutoffs on calibration rows of the same period."""
    split = cohorts.split_calibration(records, seed, calibration_share)
    keep = ["pos", "calibration", *numeric, *([category] if category else [])]
    rows = target_population(split, targets, keep)
    fitted, scored = {}, None
    for target in targets:
        mine = rows.where(F.col("target") == target)
        fitted[target] = scoring.fit_score(mine.where("NOT calibration"), target, numeric, category, **model)
        part = scoring.score(mine.where("calibration"), fitted[target]).select("target", "pos", "y", "score", "entry")
        scored = part if scored is None else scored.unionByName(part)
    # Every cutoff question passes over the scores; written once, features and trees run once.
    return fitted, scoring.calibration_cutoffs(materialize(scored, "calibration-scores"), year, fractions)


def score_targets(rows: DataFrame, fitted: Mapping[str, scoring.FittedScore]) -> DataFrame:
    """Each target's population scored by its own model."""
    out = None
    for target, model in fitted.items():
        part = scoring.score(rows.where(F.col("target") == target), model).select("target", "pos", "y", "score", "entry")
        out = part if out is None else out.unionByName(part)
    return out


def frozen_score_audit(
    population: DataFrame, thresholds: DataFrame, targets: Sequence[str], fractions: Sequence[float] = FRACTIONS,
    replicates: int = 500, seed: int = 2027, threshold_year: int = 2022, rows_per_task: int = ROWS_PER_TASK,
) -> dict[str, DataFrame]:
    """All result tables of one evaluation period.

    ``population``: target, pos, y, score, entry. Thresholds are judged before the population is read. The
    bootstrap uses block resamples; no replicates means no intervals.
    """
    checks.require(tables.threshold_violations(thresholds, targets, fractions, threshold_year), "thresholds")
    scored = materialize(population.select("target", "pos", "y", "score", "entry"), "population")
    checks.require(checks.score_check(scored).where("NOT valid"), "scores")
    checks.require(checks.entry_check(scored, ["target"]).where("NOT valid"), "entry values")
    checks.require(checks.position_check(scored), "positions")

    work = worklist(scored, cohorts.scenarios(), rows_per_task=rows_per_task)
    cells = materialize(decompose.four_cells(work, fractions), "four_cells")
    effects = materialize(decompose.decomposition(cells), "decomposition")
    checks.require(checks.identity_violations(effects, list(decompose.RESIDUALS), ["target", "nominal_fraction"]), "identities")
    protocols = materialize(selection.protocol_rows(work, thresholds, fractions), "protocols")
    checks.require(checks.protocol_invariants(protocols, fractions=len(fractions)).where("NOT holds"), "protocol invariants")
    compared = selection.comparisons(protocols)
    transported = selection.transport(work, thresholds, fractions)
    out = {
        "cohort_counts": cohorts.cohort_flow(scored),
        "four_cells": cells, "decomposition": effects, "protocol_results": protocols, "protocol_comparisons": compared,
        "threshold_transport": transported, "workload": selection.workload_difference(transported),
        "ordered_decomposition": decompose.ordered_decomposition(work, fractions),
        "model_diagnostics": diagnostics.model_diagnostics(scored, rows_per_task=rows_per_task),
        "marginal_yield": decompose.marginal_yield(protocols), "random_benchmark": decompose.random_benchmark(work, fractions),
    }
    summary = decompose.with_capacity_share(effects)
    if replicates:
        rows = materialize(bootstrap.cell_replicates(
            bootstrap.block_cell_tp(scored, effects, replicates, seed, fractions, rows_per_task=rows_per_task)), "replicates")
        checks.require(bootstrap.replicate_check(rows, ["target", "nominal_fraction"], replicates), "replicates")
        checks.require(checks.identity_violations(
            rows, list(decompose.RESIDUALS), ["target", "nominal_fraction", "replicate"]), "replicate identities")
        intervals = bootstrap.cell_intervals(rows)
        per_protocol = bootstrap.protocol_replicates(
            bootstrap.block_protocol_counts(scored, thresholds, replicates, seed, fractions, rows_per_task=rows_per_task))
        out |= {
            "bootstrap_replicates": rows, "shapley_main_results": decompose.audit_report(effects, intervals),
            "protocol_bootstrap_replicates": per_protocol,
            "protocol_bootstrap_summary": bootstrap.protocol_summary(per_protocol, compared),
        }
        summary = summary.join(intervals.drop("replicates"), ["target", "nominal_fraction"])
    return out | {"summary": summary}


def condition_grid(
    population: DataFrame, sets: Mapping[str, grid.Availability], thresholds: DataFrame, by: Sequence[str],
    conditions: Sequence[str], order: Sequence[str], fractions: Sequence[float], rows_per_task: int = ROWS_PER_TASK,
) -> dict[str, DataFrame]:
    """All nine grid tables. ``by`` are the population's group columns, ``conditions`` what summaries group by."""
    work = grid.grid_worklist(population, sets, by, rows_per_task)
    keys = [*by, *next(iter(sets.values())).labels, "nominal_fraction"]
    cells = grid.grid_cells(work, sets, fractions)
    effects = materialize(grid.grid_effects(cells, keys), "grid_effects")
    protocols = materialize(grid.grid_protocols(work, sets, cells, thresholds, fractions), "grid_protocols")
    compared = grid.grid_comparisons(protocols, keys)
    checks.require(checks.grid_invariants(protocols, compared, effects, keys).where("broken_groups > 0"), "grid invariants")
    summary = materialize(grid.effect_summary(effects, conditions), "grid_summary")
    table = grid.condition_table(summary, conditions, order)
    return {
        "protocol_results": protocols, "protocol_comparisons": compared,
        "condition_replicates": grid.availability_table(work, sets),
        "comparison_summary": grid.comparison_summary(compared, conditions),
        "shapley_replicates": effects, "shapley_summary": summary, "condition_summary": table,
        "sign_reversals": grid.sign_reversals(table), "ci_below_zero": grid.intervals_below_zero(table),
    }
