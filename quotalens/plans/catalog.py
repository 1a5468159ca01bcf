"""Registered queries: every operator bound to the test tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.functions import cleaning
from quotalens.functions.numeric import platt
from quotalens.names import ALL, ANY, EARLY, FIXED_BUDGET, FIXED_THRESHOLD, FRACTIONS, TOP_FRACTION
from quotalens.operators import bootstrap, checks, decompose, diagnostics, draws, features, grid, scoring, selection
from quotalens.operators.cohorts import (
    by_target, cohort_flow, entry_group, flow_identities, scenarios, split_calibration,
)
from quotalens.operators.ranking import Worklist, kth_of, kth_score, ranked, worklist
from quotalens.plans import bindings as b
from quotalens.plans.audit import target_population
from quotalens.plans.sql_surface import register_audit
from quotalens.session import ROWS_PER_TASK, materialize, shared_folder
from quotalens.sources import clustered, commits, sinks, tables
from quotalens.streaming.transport import window_workload, write_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Replicates of every query that gives intervals, and of those that list single replicates, which are checks of the sampler.
INTERVAL_REPLICATES, REPLICATES = 500, 20
SEED = 2027


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _work(spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK, score: str = "score") -> Worklist:
    return worklist(b.orders_population(spark, folder, score), scenarios(), rows_per_task=rows_per_task)


def _cells_work(spark: SparkSession, folder: str, rows_per_task: int = ROWS_PER_TASK, score: str = "score") -> Worklist:
    """The same without the middle scenario, which the four cells do not use."""
    ends = {name: member for name, member in scenarios().items() if name in (EARLY, ALL)}
    return worklist(b.orders_population(spark, folder, score), ends, rows_per_task=rows_per_task)


def _cuts(spark: SparkSession, folder: str, score: str = "score") -> DataFrame:
    return kth_score(b.orders_population(spark, folder, score), FRACTIONS)


# --- Four cells and decompositions ------------------------------------------------------------------------------

@query
def four_cells(spark, folder):
    return decompose.four_cells(_cells_work(spark, folder))


@query
def four_cells_bucketed(spark, folder):
    """Same result through the score histogram, the plan for populations larger than one task."""
    return decompose.four_cells(_cells_work(spark, folder, rows_per_task=5_000))


def _clustered(spark, folder, scenarios_wanted):
    path = _new_path(spark, "clustered")
    clustered.write_clustered(b.orders_population(spark, folder), scenarios_wanted, path, rows_per_file=5_000)
    return clustered.open_clustered(spark, path)


@query
def four_cells_clustered(spark, folder):
    """Same result from a population stored in ranking order: only the slices in which a budget runs out are read."""
    return decompose.four_cells(_clustered(spark, folder, {name: m for name, m in scenarios().items() if name in (EARLY, ALL)}))


@query
def protocols_clustered(spark, folder):
    """All protocols from the stored population; thresholds too are answered from the histogram and the slices they cut."""
    work = _clustered(spark, folder, {ALL: scenarios()[ALL], **scenarios()})
    return selection.protocol_rows(work, kth_of(work, FRACTIONS))


@query
def selected_rows_clustered(spark, folder):
    """The early cohort's top tenth from the stored population: slices below the boundary stay unread."""
    work = _clustered(spark, folder, scenarios())
    asked = selection.budget_requests(work, (0.1,)).where(
        (F.col("protocol") == TOP_FRACTION) & (F.col("scenario") == EARLY)).select("target", "scenario", "budget_n")
    return selection.select_top(work.rows, work, asked)


@query
def decomposition(spark, folder):
    return decompose.decomposition(decompose.four_cells(_cells_work(spark, folder)))


@query
def capacity_share(spark, folder):
    return decompose.with_capacity_share(decomposition(spark, folder)).select(
        "target", "nominal_fraction", "shapley_capacity", "total_topq_contrast", "capacity_share")


@query
def headline(spark, folder):
    return decompose.headline(decomposition(spark, folder))


@query
def headline_range(spark, folder):
    return decompose.headline_range(headline(spark, folder))


@query
def ordered_decomposition(spark, folder):
    return decompose.ordered_decomposition(_cells_work(spark, folder))


@query
def random_benchmark(spark, folder):
    return decompose.random_benchmark(_cells_work(spark, folder))


@query
def sensitivity(spark, folder):
    effects, contrasts = [], []
    for score in ("score", "fine_score"):
        work = _work(spark, folder, score=score)
        effects.append(decompose.decomposition(decompose.four_cells(work)))
        contrasts.append(selection.comparisons(selection.protocol_rows(
            work, _cuts(spark, folder, score), protocols=(FIXED_THRESHOLD,))))
    return decompose.sensitivity(*effects, "coarse", "fine", contrasts=tuple(contrasts))


@query
def identity_check(spark, folder):
    return checks.identity_summary(decomposition(spark, folder), list(decompose.RESIDUALS))


@query
def sql_decomposition(spark, folder):
    """The decomposition through SQL table functions alone, over a stored population."""
    register_audit(spark, _clustered(spark, folder, scenarios()))
    return spark.sql("SELECT * FROM audit_decomposition(0.05) UNION ALL SELECT * FROM audit_decomposition(0.1)")


@query
def sql_top(spark, folder):
    """Selections of every scenario at a share that nobody prepared, through SQL alone."""
    register_audit(spark, _clustered(spark, folder, scenarios()))
    return spark.sql("SELECT scenario, target, budget_n, true_positive_n FROM audit_top(0.03) WHERE budget_of = 'own'")


# --- Cohorts ----------------------------------------------------------------------------------------------------

@query
def cohort_counts(spark, folder):
    return cohort_flow(b.orders_population(spark, folder))


@query
def cohort_identities(spark, folder):
    return flow_identities(cohort_counts(spark, folder))


@query
def entry_groups(spark, folder):
    rows = b.orders_population(spark, folder).withColumn("entry_group", entry_group())
    return rows.groupBy("target", "entry_group").agg(F.count(F.lit(1)).alias("n_records"), F.sum("y").alias("event_n"))


@query
def primary_cohort_flow(spark, folder):
    """Fixed-width lines to resident singletons per target to cohort counts."""
    parsed = cleaning.accepted(cleaning.parse_strict(b.rendered_lines(spark, folder), 2022))
    return cohort_flow(target_population(parsed, ["target_preterm", "target_nicu", "target_lbw"], ["pos"]))


@query
def hash_split(spark, folder):
    return split_calibration(b.order_records(spark, folder), 2026).select("pos", "calibration")


@query
def period_split(spark, folder):
    rows = b.events_population(spark, folder)
    return rows.groupBy("calibration").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("y").alias("event_n"), F.count_if(F.col("entry").between(1, 3)).alias("early_n"))


# --- Protocols and selections -----------------------------------------------------------------------------------

@query
def protocol_a(spark, folder):
    return selection.protocol_rows(_work(spark, folder), None, protocols=(TOP_FRACTION,))


@query
def protocol_b(spark, folder):
    return selection.protocol_rows(_work(spark, folder), None, protocols=(FIXED_BUDGET,))


@query
def protocol_c(spark, folder):
    return selection.protocol_rows(_work(spark, folder), _cuts(spark, folder), protocols=(FIXED_THRESHOLD,))


@query
def protocols(spark, folder):
    return selection.protocol_rows(_work(spark, folder), _cuts(spark, folder))


@query
def comparisons(spark, folder):
    return selection.comparisons(protocols(spark, folder))


@query
def marginal_yield(spark, folder):
    return decompose.marginal_yield(protocols(spark, folder))


@query
def protocol_invariants(spark, folder):
    return checks.protocol_invariants(protocols(spark, folder))


@query
def cutoffs_from_protocols(spark, folder):
    return tables.cutoffs_from_protocols(protocols(spark, folder))


@query
def ranked_early(spark, folder):
    return ranked(b.orders_population(spark, folder), eligible=scenarios()[EARLY]).select("target", "pos", "rank", "cum_event_n")


@query
def ranked_sliced(spark, folder):
    """Full ranking through range slices, the plan for groups larger than one task."""
    return ranked(b.orders_population(spark, folder), rows_per_task=1_000).select("target", "pos", "rank", "cum_event_n")


@query
def capture_curve(spark, folder):
    return selection.ranked_scan(_work(spark, folder), ANY)


@query
def selected_rows(spark, folder):
    """The records of the early cohort's top tenth."""
    work = _work(spark, folder)
    asked = selection.budget_requests(work, (0.1,)).where(
        (F.col("protocol") == TOP_FRACTION) & (F.col("scenario") == EARLY)).select("target", "scenario", "budget_n")
    return selection.select_top(work.rows, work, asked)


@query
def threshold_rows(spark, folder):
    """Early events of the evaluation period at or above a transported threshold."""
    return selection.threshold_select(
        b.events_population(spark, folder, calibration=False), 100.0, scenarios()[EARLY]).select("pos", "score", "y")


# --- Thresholds -------------------------------------------------------------------------------------------------

@query
def kth_scores(spark, folder):
    return kth_score(b.events_population(spark, folder, calibration=True), FRACTIONS)


@query
def realized_with_ties(spark, folder):
    coarse = b.events_population(spark, folder, calibration=True).withColumn("score", F.floor(F.col("score")))
    return diagnostics.realized_with_ties(coarse, kth_score(coarse, FRACTIONS), FRACTIONS)


def _evaluation(spark, folder):
    return worklist(b.events_population(spark, folder, calibration=False), scenarios())


@query
def threshold_transport(spark, folder):
    cuts = kth_scores(spark, folder).withColumn("threshold", F.col("threshold") / 7)
    return selection.transport(_evaluation(spark, folder), cuts)


@query
def workload_difference(spark, folder):
    return selection.workload_difference(selection.transport(_evaluation(spark, folder), kth_scores(spark, folder)))


def _period_store(spark, folder) -> str:
    """Events of both periods, added to a store one after the other."""
    path = _new_path(spark, "periods")
    for period in ("calibration", "evaluation"):
        clustered.append_period(b.events_population(spark, folder, period == "calibration"), {ALL: F.lit(True), **scenarios()}, path, period)
    return path


@query
def period_cutoffs(spark, folder):
    """Cutoffs of the first period and of both, from stored histograms and the rows of the bins they fall into."""
    path = _period_store(spark, folder)
    both = kth_of(clustered.open_periods(spark, path), FRACTIONS).withColumn("periods", F.lit("both"))
    return both.unionByName(kth_of(clustered.open_periods(spark, path, ["calibration"]), FRACTIONS).withColumn("periods", F.lit("calibration")))


@query
def period_transport(spark, folder):
    """A threshold of the stored first period on the stored second one."""
    path = _period_store(spark, folder)
    cuts = kth_of(clustered.open_periods(spark, path, ["calibration"]), FRACTIONS).withColumn("threshold", F.col("threshold") / 7)
    return selection.transport(clustered.open_periods(spark, path, ["evaluation"]), cuts)


@query
def streamed_workload(spark, folder):
    """Evaluation events as a stream: daily selections of the calibration cutoffs, of the days that the watermark has closed."""
    # A pattern, since a stream's plain path has to be a directory.
    events = spark.readStream.schema(b.table(spark, folder, "events").schema).parquet(f"{folder}/event[s].parquet")
    scored = events.where(F.col("ts") >= F.lit("2024-01-21").cast("timestamp_ntz")).select(
        F.lit("purchase").alias("target"), "ts", F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    path = _new_path(spark, "windows")
    write_windows(window_workload(scored, kth_scores(spark, folder)), path, f"{path}-checkpoint").awaitTermination()
    day = "cast(date_add(date'1970-01-01', cast(unix_seconds({}) div 86400 as int)) as string)"
    return spark.read.parquet(path).withColumns({c: F.expr(day.format(c)) for c in ("window_start", "window_end")})


@query
def threshold_binding(spark, folder):
    """Cutoffs that were rounded on the way do not match the model's own."""
    own = kth_score(b.orders_population(spark, folder, "fine_score"), FRACTIONS)
    rounded = own.withColumn("threshold", F.when(F.col("target") == "is_f", F.bround("threshold", -1)).otherwise(F.col("threshold")))
    return tables.binding_violations(rounded, own)


@query
def threshold_problems(spark, folder):
    """Everything wrong with a thresholds table that lacks a target, repeats a row and leaves [0, 1]."""
    cuts = _cuts(spark, folder).where("target = 'is_f'").select(
        "target", "nominal_fraction", (F.col("threshold") / 500).alias("threshold"), F.lit(2021).alias("source_year"))
    again = cuts.where("nominal_fraction = 0.05").withColumn("threshold", F.col("threshold") * 2)
    return tables.threshold_violations(cuts.unionByName(again), ["is_f", "is_urgent"], FRACTIONS)


# --- Diagnostics and calibration --------------------------------------------------------------------------------

def _rounded(df: DataFrame, digits: int = 9, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({
        c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double" and c not in ("nominal_fraction", *skip)
    })


@query
def model_diagnostics(spark, folder):
    return _rounded(diagnostics.model_diagnostics(b.documents_population(spark, folder)))


@query
def model_diagnostics_bucketed(spark, folder):
    """Same formulas on heavily tied order scores through range slices."""
    return _rounded(diagnostics.model_diagnostics(b.orders_population(spark, folder), rows_per_task=1_000))


def _periods(spark, folder):
    rows = b.events_population(spark, folder).withColumn("score", F.col("score") / (F.col("score") + 100.0))
    return diagnostics.period_diagnostics(rows, "calibration")


@query
def period_diagnostics(spark, folder):
    return _rounded(_periods(spark, folder))


@query
def drift_skill(spark, folder):
    return _rounded(diagnostics.drift_and_skill(_periods(spark, folder)))


@query
def platt_scores(spark, folder):
    rows = b.documents_population(spark, folder).withColumn("calibrated", platt(F.col("score"), -0.7, 1.4, 1e-12))
    return _rounded(rows.select("target", "pos", "calibrated"))


@query
def platt_rank_check(spark, folder):
    rows = b.documents_population(spark, folder).withColumn("calibrated", platt(F.col("score"), -0.7, 1.4, 1e-12))
    return scoring.rank_agreement(rows, "calibrated")


# --- Cleaning ---------------------------------------------------------------------------------------------------

def _parsed(spark, folder):
    return cleaning.parse_strict(b.rendered_lines(spark, folder), 2022)


@query
def fixed_width_parse(spark, folder):
    return cleaning.accepted(_parsed(spark, folder))


@query
def fixed_width_lenient(spark, folder):
    return cleaning.parse_lenient(b.rendered_lines(spark, folder, lenient=True))


@query
def rejects(spark, folder):
    return cleaning.rejects(_parsed(spark, folder))


@query
def derive_targets(spark, folder):
    return fixed_width_parse(spark, folder).select(
        "pos", "is_us_resident", "is_singleton", "target_preterm", "target_nicu", "target_lbw", "target_gdm")


@query
def field_profile(spark, folder):
    return sinks.line_profile(b.rendered_lines(spark, folder), 2022)


@query
def normalized_frame(spark, folder):
    frame = fixed_width_parse(spark, folder).select(
        "pos", "is_us_resident", "prenatal_care_month", "mother_race", "gestation_oe_weeks", "birth_weight_g", "admit_nicu")
    return cleaning.normalize_frame(frame)


@query
def canonical_text(spark, folder):
    """Canonical text of decimal and integer fields."""
    rows = fixed_width_parse(spark, folder)
    return rows.select("pos", *[
        cleaning.render(cleaning.FIELD[c], F.col(c)).alias(c) for c in ("mother_bmi", "birth_weight_g", "mother_race", "wic_benefits")
    ])


@query
def table_fingerprint(spark, folder):
    rows = b.table(spark, folder, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return tables.fingerprint(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "cents", "o_orderpriority"])


# --- Sources and sinks: written, read back, returned ------------------------------------------------------------

def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, folder):
    """Orders as CSV, read back by projection with types and a row lock."""
    path, rows = _new_path(spark, "csv"), b.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    sinks.write_results({"orders": rows}, path, "csv")
    kinds = {"o_orderkey": "bigint", "o_totalprice": "double"}
    return tables.read_csv(spark, f"{path}/orders", ["o_totalprice", "o_orderkey", "o_orderpriority"], kinds, rows.count())


@query
def threshold_source(spark, folder):
    """Cutoffs with provenance through a CSV file, bit for bit."""
    path = _new_path(spark, "thresholds")
    cuts = kth_score(b.events_population(spark, folder, True), FRACTIONS).select(
        "target", "nominal_fraction", "threshold", F.lit(2022).alias("source_year"), F.lit(">=").alias("comparator"))
    sinks.write_results({"cuts": cuts}, path, "csv")
    return tables.read_thresholds(spark, f"{path}/cuts")


@query
def published_table(spark, folder):
    """Customers published under their row count and fingerprint, read from the destination."""
    rows = b.table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    path, lock = _new_path(spark, "published"), tables.fingerprint(rows, rows.columns).first().asDict()
    sinks.publish(rows, path, lock["rows"], lock)
    return spark.read.parquet(path)


@query
def guarded_table(spark, folder):
    """The scored population, published under guards that are counted while it is written."""
    rows = b.orders_population(spark, folder)
    path = _new_path(spark, "guarded")
    sinks.publish(rows, path, guards=checks.guards(rows, ["y"], False, "entry", "score"))
    return spark.read.parquet(path).groupBy("target").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("event_n"), F.count("entry").alias("known_entry_n"), F.sum("score").alias("score_sum"))


@query
def committed_tables(spark, folder):
    """Decomposition and headline of one run, committed together twice and read from the last version."""
    root, effects = _new_path(spark, "committed"), materialize(decomposition(spark, folder), "decomposition")
    commits.commit_tables({"decomposition": effects.limit(0), "headline": decompose.headline(effects).limit(0)}, root)
    commits.commit_tables({"decomposition": effects, "headline": decompose.headline(effects)}, root)
    left = commits.read_table(spark, root, "decomposition").select("target", "nominal_fraction", "shapley_capacity", "total_topq_contrast")
    return left.join(commits.read_table(spark, root, "headline"), ["target", "nominal_fraction"])


@query
def score_export(spark, folder):
    path = _new_path(spark, "scores")
    sinks.export_scores(b.orders_population(spark, folder), path)
    return spark.read.parquet(path).groupBy("target").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("event_n"), F.count("entry").alias("known_entry_n"), F.sum("score").alias("score_sum"))


@query
def run_record(spark, folder):
    """What a publishing run records about itself: rows and fingerprint of the published orders."""
    rows = b.table(spark, folder, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    path = _new_path(spark, "recorded")
    facts = sinks.publish(rows, path, columns=["o_orderkey", "o_custkey", "o_orderstatus", "cents", "o_orderpriority"])
    sinks.write_run_record(spark, f"{path}.record", status="PASS", **facts)
    record = spark.read.text(f"{path}.record").select(
        F.from_json("value", "status string, rows bigint, xor_hash bigint, sum_hash string").alias("r"))
    return record.select("r.*")


@query
def file_lock(spark, folder):
    """Fingerprints of text files against a lock that matches, differs in a file, names one too many and one too few."""
    path = _new_path(spark, "locked")
    orders = b.table(spark, folder, "orders")
    orders.select("o_orderstatus", F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("value")).write.partitionBy("o_orderstatus").text(path)
    seen = materialize(tables.file_fingerprints(spark, path, ordered=True), "lock")
    first = F.col("name") == seen.agg(F.min("name")).first()[0]
    locks = {
        "match": seen, "changed": seen.withColumn("rows", F.when(first, F.col("rows") + 1).otherwise(F.col("rows"))),
        "missing": seen.unionByName(seen.where(first).withColumn("name", F.lit("gone.txt"))), "additional": seen.where(~first),
    }
    counts = [
        tables.manifest_violations(seen, lock).agg(F.count(F.lit(1)).alias("violation_n")).select(F.lit(name).alias("input"), "violation_n")
        for name, lock in locks.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("line_n", F.lit(seen.agg(F.sum("rows")).first()[0]).cast("bigint"))


# --- Checks -----------------------------------------------------------------------------------------------------

@query
def score_guard(spark, folder):
    """Cutoffs from finite, missing, NaN and infinite scores, by the plan for one task and by the plan with buckets."""
    rows = materialize(b.events_population(spark, folder, True), "scored")
    every = F.col("pos") % 97 == 0
    bad = {"finite": None, "missing": F.lit(None).cast("double"), "nan": F.lit(float("nan")), "infinite": F.lit(float("inf"))}
    out = []
    for name, value in bad.items():
        given = rows if value is None else rows.withColumn("score", F.when(every, value).otherwise(F.col("score")))
        for plan, size in (("one task", ROWS_PER_TASK), ("buckets", 50)):
            try:
                cuts = [r.threshold for r in kth_score(given, FRACTIONS, rows_per_task=size).collect()]
            except PySparkException as e:
                if "score is not finite" not in str(e):
                    raise
                cuts = None
            out.append((name, plan, cuts is None, None if cuts is None else float(sum(cuts))))
    return spark.createDataFrame(out, "input string, plan string, refused boolean, threshold_sum double")


@query
def binary_check(spark, folder):
    rows = b.order_records(spark, folder).withColumn("month", F.col("entry"))
    return checks.binary_check(rows, ["is_f", "is_urgent", "month"], allow_missing=False)


@query
def entry_check(spark, folder):
    rows = b.table(spark, folder, "events").select("event_type", (F.col("value") / 10).alias("entry"))
    return checks.entry_check(rows, ["event_type"])


@query
def entry_violations(spark, folder):
    rows = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"), (F.month("o_orderdate") - 1).cast("double").alias("entry"))
    return checks.entry_violations(rows)


@query
def score_check(spark, folder):
    rows = b.orders_population(spark, folder).withColumn(
        "score", F.when(F.col("score") > 490, F.lit(float("nan"))).when(F.col("score") > 480, F.lit(float("inf"))).otherwise(F.col("score")))
    return checks.score_check(rows)


@query
def position_check(spark, folder):
    """Keys of lineitem that are no unique position."""
    rows = b.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_orderkey").alias("pos"))
    return checks.position_check(rows)


# --- Bootstrap --------------------------------------------------------------------------------------------------

@query
def bootstrap_counts(spark, folder):
    return _of_resamples(spark, folder, draws.draw_counts)


def _of_resamples(spark, folder, ask: Callable[[Worklist], DataFrame], replicates: int = REPLICATES) -> DataFrame:
    return draws.in_waves(b.orders_population(spark, folder), scenarios(), replicates, SEED, ask)


def _cell_replicates(spark, folder, replicates: int = REPLICATES):
    budgets = materialize(decomposition(spark, folder).select("target", "nominal_fraction", "B_early", "B_all"), "budgets")
    return bootstrap.cell_replicates(_of_resamples(spark, folder, lambda work: bootstrap.cell_tp(work, budgets), replicates))


@query
def bootstrap_cells(spark, folder):
    return _cell_replicates(spark, folder)


@query
def bootstrap_intervals(spark, folder):
    return _rounded(bootstrap.cell_intervals(_cell_replicates(spark, folder, INTERVAL_REPLICATES)))


def _protocol_replicates(spark, folder, replicates: int = REPLICATES):
    cuts = materialize(_cuts(spark, folder), "cuts")
    return bootstrap.protocol_replicates(_of_resamples(spark, folder, lambda work: bootstrap.protocol_counts(work, cuts), replicates))


@query
def bootstrap_protocols(spark, folder):
    return _protocol_replicates(spark, folder)


@query
def bootstrap_summary(spark, folder):
    return _rounded(bootstrap.protocol_summary(_protocol_replicates(spark, folder, INTERVAL_REPLICATES), comparisons(spark, folder)))


@query
def bootstrap_row_check(spark, folder):
    """Rows per group and replicate, for the replicates as they are and for two inputs that must fail."""
    rows = materialize(_cell_replicates(spark, folder).select("target", "nominal_fraction", "replicate"), "replicates")
    judged = rows.select(F.lit("whole").alias("input"), "*").unionByName(
        rows.where("replicate > 0").select(F.lit("without the first").alias("input"), "*")).unionByName(
        rows.withColumn("replicate", F.greatest("replicate", F.lit(1))).select(F.lit("one twice").alias("input"), "*"))
    return bootstrap.replicate_counts(judged, ["input", "target", "nominal_fraction"], REPLICATES)


@query
def audit_report(spark, folder):
    return _rounded(decompose.audit_report(
        decomposition(spark, folder), bootstrap.cell_intervals(_cell_replicates(spark, folder, INTERVAL_REPLICATES))))


@query
def block_bootstrap_cells(spark, folder):
    tp = bootstrap.block_cell_tp(b.orders_population(spark, folder), decomposition(spark, folder), INTERVAL_REPLICATES, SEED)
    return bootstrap.cell_intervals(bootstrap.cell_replicates(tp))


@query
def block_bootstrap_protocols(spark, folder):
    counts = bootstrap.block_protocol_counts(b.orders_population(spark, folder), _cuts(spark, folder), INTERVAL_REPLICATES, SEED)
    return bootstrap.protocol_summary(bootstrap.protocol_replicates(counts), comparisons(spark, folder))


# --- Condition grid ---------------------------------------------------------------------------------------------

GRID_KEYS = (*b.GRID_BY, *b.GRID_LABELS, "nominal_fraction")
GRID_CONDITIONS = ("model_quality", *b.GRID_LABELS, "nominal_fraction")
GRID_ORDER = (*b.GRID_LABELS, "model_quality", "nominal_fraction")


def _grid_work(spark, folder) -> Worklist:
    return grid.grid_worklist(b.grid_population(spark, folder, False), b.grid_sets(), b.GRID_BY)


def _grid_cells(spark, folder, work: Worklist | None = None):
    return grid.grid_cells(work or _grid_work(spark, folder), b.grid_sets(), b.GRID_FRACTIONS)


def _grid_effects(spark, folder):
    return grid.grid_effects(_grid_cells(spark, folder), GRID_KEYS)


def _grid_protocols(spark, folder):
    work = _grid_work(spark, folder)
    cuts = grid.grid_thresholds(b.grid_population(spark, folder, True), b.GRID_BY, b.GRID_FRACTIONS)
    return grid.grid_protocols(work, b.grid_sets(), _grid_cells(spark, folder, work), cuts, b.GRID_FRACTIONS)


@query
def grid_thresholds(spark, folder):
    return grid.grid_thresholds(b.grid_population(spark, folder, True), b.GRID_BY, b.GRID_FRACTIONS)


@query
def grid_availability(spark, folder):
    return grid.availability_table(_grid_work(spark, folder), b.grid_sets())


@query
def grid_protocols(spark, folder):
    return _grid_protocols(spark, folder)


@query
def grid_comparisons(spark, folder):
    return grid.grid_comparisons(_grid_protocols(spark, folder), GRID_KEYS)


@query
def grid_audit(spark, folder):
    return _grid_effects(spark, folder)


@query
def grid_audit_scaled(spark, folder):
    """The same effects with the scores of each replicate and quality on a scale of their own, through buckets of each group."""
    rows = b.grid_population(spark, folder, False).withColumn(
        "score", F.col("score") * F.pow(F.lit(4.0), F.col("replicate") * 3 + F.when(F.col("model_quality") == "weak", 16).otherwise(0)))
    work = grid.grid_worklist(rows, b.grid_sets(), b.GRID_BY, rows_per_task=500)
    return grid.grid_effects(_grid_cells(spark, folder, work), GRID_KEYS)


@query
def grid_invariants(spark, folder):
    rows = materialize(_grid_protocols(spark, folder), "grid_protocols")
    return checks.grid_invariants(rows, grid.grid_comparisons(rows, GRID_KEYS), _grid_effects(spark, folder), GRID_KEYS)


@query
def grid_comparison_summary(spark, folder):
    return _rounded(grid.comparison_summary(grid.grid_comparisons(_grid_protocols(spark, folder), GRID_KEYS), GRID_CONDITIONS))


@query
def grid_summary(spark, folder):
    return _rounded(grid.effect_summary(_grid_effects(spark, folder), GRID_CONDITIONS))


def _condition_table(spark, folder):
    return _rounded(grid.condition_table(
        grid.effect_summary(_grid_effects(spark, folder), GRID_CONDITIONS), GRID_CONDITIONS, GRID_ORDER))


@query
def condition_table(spark, folder):
    return _condition_table(spark, folder)


@query
def sign_reversals(spark, folder):
    return grid.sign_reversals(_condition_table(spark, folder))


@query
def intervals_below_zero(spark, folder):
    return grid.intervals_below_zero(_condition_table(spark, folder))


# --- Features and scoring ---------------------------------------------------------------------------------------

NUMERIC = ("acctbal", "price", "month")


def _train(spark, folder):
    return split_calibration(b.feature_records(spark, folder), 2026).where("NOT calibration")


@query
def feature_medians(spark, folder):
    return _rounded(features.exact_quantile(_train(spark, folder), NUMERIC))


@query
def feature_modes(spark, folder):
    return features.most_frequent(_train(spark, folder), ["nation", "price"])


@query
def feature_parameters(spark, folder):
    p = features.fit_features(_train(spark, folder), NUMERIC, "nation")
    rows = [(n, m, round(mean, 6), round(s, 6)) for n, m, mean, s in zip(p.numeric, p.medians, p.means, p.scales)]
    rows.append(("nation", float(p.mode), None, float(len(p.categories))))
    return spark.createDataFrame(rows, "feature string, fill double, mean double, scale double")


@query
def frozen_transform(spark, folder):
    """The assembled matrix in long form: one row per record and non-zero matrix column."""
    rows = features.transform_features(b.feature_records(spark, folder), b.FROZEN)
    return rows.select("pos", F.posexplode("features").alias("matrix_column", "x")).where("x != 0").select(
        "pos", "matrix_column", F.col("x").cast("double").alias("x"))


@query
def fit_score(spark, folder):
    """Boosted trees on training rows, scores on the rest, and their diagnostics."""
    rows = split_calibration(b.feature_records(spark, folder), 2026)
    fitted = scoring.fit_score(rows.where("NOT calibration"), "is_f", NUMERIC, "nation")
    return diagnostics.model_diagnostics(scoring.score(rows.where("calibration"), fitted))


@query
def calibration_cutoffs(spark, folder):
    rows = split_calibration(b.feature_records(spark, folder), 2026)
    fitted = scoring.fit_score(rows.where("NOT calibration"), "is_f", NUMERIC, "nation")
    scored = materialize(scoring.score(rows.where("calibration"), fitted).select("target", "pos", "y", "score"), "scored")
    return scoring.calibration_cutoffs(scored, 2022)


@query
def score_reload(spark, folder):
    """A fitted score saved and loaded: rows calibrated, rows whose score changed, scores out of range, cutoffs met too rarely."""
    rows = split_calibration(b.feature_records(spark, folder), 2026)
    fitted = scoring.fit_score(rows.where("NOT calibration"), "is_f", NUMERIC, "nation")
    path = _new_path(spark, "score")
    scoring.save_score(fitted, spark, path)
    again = scoring.load_score(spark, path)
    both = scoring.score(scoring.score(rows.where("calibration"), fitted).select("target", "pos", "y", "score", *NUMERIC, "nation"), again, "reloaded")
    both = materialize(both.select("target", "pos", "y", "score", "reloaded"), "rescored")
    cuts = scoring.calibration_cutoffs(both, 2022).join(both, "target").groupBy("target", "nominal_fraction", "calibration_n").agg(
        F.count_if(F.col("score") >= F.col("threshold")).alias("reached_n"), F.count_if(F.col("score") != F.col("reloaded")).alias("changed_n"),
        F.count_if(~F.col("score").between(0, 1)).alias("out_of_range_n"))
    nominal = F.round(F.col("nominal_fraction") * F.col("calibration_n") - 0.5)
    return cuts.select("target", "nominal_fraction", "calibration_n", "changed_n", "out_of_range_n", (F.col("reached_n") >= nominal).alias("reaches_nominal"))


@query
def feature_table(spark, folder):
    """The strict feature list of the cleaned records, in its fixed order."""
    return features.feature_set(cleaning.accepted(_parsed(spark, folder)), "landmark_strict", ["pos"])
