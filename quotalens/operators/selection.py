"""Selection by share, by absolute budget and by threshold, and the access metrics of a selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import budget, ratio
from quotalens.names import ALL, FIXED_BUDGET, FIXED_THRESHOLD, FRACTIONS, PAIRS, TOP_FRACTION
from quotalens.operators.ranking import Worklist, at_most, each_fraction, rank_order, running_totals, slices_for, top_b
from quotalens.session import materialize

#: Access metrics in report order.
METRICS = (
    "full_population_n", "full_population_event_n", "eligible_n", "eligible_event_n", "selected_n", "true_positive_n",
    "selection_rate_among_eligible", "precision", "recall_among_eligible", "population_event_capture",
    "event_availability_ceiling",
)


def access_metrics(counts: DataFrame) -> DataFrame:
    """Add the five rates to a table of counts. The capture denominator is all events, eligible or not."""
    return counts.withColumns({
        "selection_rate_among_eligible": ratio(F.col("selected_n"), F.col("eligible_n")),
        "precision": ratio(F.col("true_positive_n"), F.col("selected_n")),
        "recall_among_eligible": ratio(F.col("true_positive_n"), F.col("eligible_event_n")),
        "population_event_capture": ratio(F.col("true_positive_n"), F.col("full_population_event_n")),
        "event_availability_ceiling": ratio(F.col("eligible_event_n"), F.col("full_population_event_n")),
    })


def _sizes(work: Worklist, name: str) -> list[Column]:
    return [
        F.lit(name).alias("scenario"),
        work.n(name).alias("eligible_n"), work.e(name).alias("eligible_event_n"),
        F.col("full_n").alias("full_population_n"), F.col("full_e").alias("full_population_event_n"),
    ]


def budget_requests(work: Worklist, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Top-fraction and fixed-budget requests for every scenario; too large a fixed budget fails the query."""
    sizes = F.array(*[F.struct(*_sizes(work, name)) for name in work.names])
    per_share = work.totals.select(*work.by, F.inline(sizes)).select("*", each_fraction(fractions))
    q, own, label = F.col("nominal_fraction"), F.col("eligible_n"), "fixed budget"
    rows = F.array(
        F.struct(F.lit(TOP_FRACTION).alias("protocol"), at_most(budget(q, own), own, "top fraction").alias("budget_n")),
        F.struct(F.lit(FIXED_BUDGET).alias("protocol"), at_most(budget(q, F.col("full_population_n")), own, label).alias("budget_n")),
    )
    return per_share.select("*", F.inline(rows))


def threshold_counts(work: Worklist, thresholds: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Selected records and events at or above a threshold, per scenario and fraction.

    ``thresholds``: by, ``nominal_fraction``, ``threshold``. One pass: the thresholds of a group travel as one
    array, so a row is never multiplied by the number of fractions. A large population is joined to thresholds
    that were written down first, so the optimizer knows whether they are small enough to broadcast.
    """
    if work.stored:
        return _stored_counts(work, thresholds, fractions)
    by = list(work.by)
    pivoted = thresholds.groupBy(*by).agg(*[
        F.max(F.when(F.col("nominal_fraction") == F.lit(float(q)), F.col("threshold"))).alias(f"t{k}")
        for k, q in enumerate(fractions)
    ])
    if work.hist is not None:
        pivoted = materialize(pivoted, "thresholds")
    sums = []
    for k in range(len(fractions)):
        for i in range(len(work.names)):
            hit = F.when(F.col(f"in{i}") & (F.col("score") >= F.col(f"t{k}")), F.col("w")).otherwise(F.lit(0))
            sums += [F.sum(hit).alias(f"s{k}_{i}"), F.sum(hit * F.col("y")).alias(f"tp{k}_{i}")]
    keep = [F.first(f"t{k}").alias(f"t{k}") for k in range(len(fractions))]
    wide = work.rows.join(pivoted, by).groupBy(*by).agg(*sums, *keep)
    answers = F.array(*[
        F.struct(
            F.lit(name).alias("scenario"), F.lit(float(q)).alias("nominal_fraction"), F.col(f"t{k}").alias("threshold"),
            F.col(f"s{k}_{i}").alias("selected_n"), F.col(f"tp{k}_{i}").alias("true_positive_n"),
        )
        for k, q in enumerate(fractions) for i, name in enumerate(work.names)
    ])
    return wide.select(*by, F.inline(answers))


def _stored_counts(work: Worklist, thresholds: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """The same of stored rows: buckets above a threshold are counted from the histogram, only those it cuts are read."""
    by, keys = list(work.by), [*work.by, "nominal_fraction", "threshold"]
    asked = materialize(thresholds.where(F.col("nominal_fraction").isin([float(q) for q in fractions])).select(*keys), "thresholds")
    spans = materialize(work.hist.join(asked, by).where(F.col("high") >= F.col("threshold")), "spans")
    edge = spans.where(F.col("low") < F.col("threshold")).select(*keys, "_bucket")
    numbers = range(len(work.names))
    names = [f"{m}{i}" for i in numbers for m in ("n", "e")]
    taken = {i: F.when(F.col(f"in{i}"), F.col("w")).otherwise(F.lit(0)) for i in numbers}
    read = work.of_buckets(edge).join(edge, [*by, "_bucket"]).where(F.col("score") >= F.col("threshold")).select(
        *keys, *[(taken[i] * (F.col("y") if m == "e" else 1)).cast("bigint").alias(f"{m}{i}") for i in numbers for m in ("n", "e")])
    none = asked.select(*keys, *[F.lit(0).cast("bigint").alias(c) for c in names])
    counted = spans.where(F.col("low") >= F.col("threshold")).select(*keys, *names).unionByName(
        read.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])).unionByName(none)
    answers = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.col(f"n{i}").alias("selected_n"), F.col(f"e{i}").alias("true_positive_n"))
        for i, name in enumerate(work.names)])
    return counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]).select(*keys, F.inline(answers)).select(
        *by, "scenario", "nominal_fraction", "threshold", "selected_n", "true_positive_n")


def _finish(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return access_metrics(rows).select(
        *by, F.col("scenario").alias("availability_scenario"), "protocol", "nominal_fraction", "budget_n", "threshold", *METRICS
    )


def protocol_rows(
    work: Worklist,
    thresholds: DataFrame | None,
    fractions: Sequence[float] = FRACTIONS,
    protocols: Sequence[str] = (TOP_FRACTION, FIXED_BUDGET, FIXED_THRESHOLD),
) -> DataFrame:
    """The three-protocol table: one row per group, share, scenario and protocol."""
    by = list(work.by)
    parts = []
    asked = [p for p in protocols if p != FIXED_THRESHOLD]
    if asked:
        picked = top_b(work, budget_requests(work, fractions).where(F.col("protocol").isin(asked)))
        parts.append(picked.withColumns({
            "selected_n": F.col("budget_n"), "threshold": F.lit(None).cast("double")
        }))
    if FIXED_THRESHOLD in protocols:
        sizes = work.totals.select(*by, F.inline(F.array(*[F.struct(*_sizes(work, n)) for n in work.names])))
        cut = threshold_counts(work, thresholds, fractions).join(sizes, [*by, "scenario"])
        parts.append(cut.withColumns({
            "protocol": F.lit(FIXED_THRESHOLD), "budget_n": F.lit(None).cast("bigint")
        }))
    finished = [_finish(p, by) for p in parts]
    return finished[0] if len(finished) == 1 else finished[0].unionByName(finished[1])


def threshold_select(df: DataFrame, threshold: float | Column, eligible: Column | None = None) -> DataFrame:
    """Eligible rows whose score reaches the threshold. Row-wise, so it also works on a stream."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    picked = F.col("score") >= limit
    return df.where(picked if eligible is None else eligible & picked)


def select_top(df: DataFrame, work: Worklist, requests: DataFrame) -> DataFrame:
    """The selected rows themselves: everything up to the last key of each request, both keys included.

    ``requests`` must hold one request per group. No sort of the population: the boundary key from
    :func:`top_b` turns the selection into a filter.
    """
    edge = top_b(work, requests).select(*work.by, "scenario", "last_score", "last_pos")
    if work.hist is not None:
        edge = materialize(edge, "edge")
    member = F.lit(False)
    for i, name in enumerate(work.names):
        member = member | ((F.col("scenario") == F.lit(name)) & F.col(f"in{i}"))
    inside = (F.col("score") > F.col("last_score")) | (
        (F.col("score") == F.col("last_score")) & (F.col("pos") <= F.col("last_pos"))
    )
    rows = work.rows
    if work.stored:  # the buckets from the top down to the boundary
        rows = work.of_buckets(work.hist.join(edge, list(work.by)).where(F.col("high") >= F.col("last_score")))
    return rows.join(edge, list(work.by)).where(member & inside).select(*work.by, "scenario", "pos", "score", "y")


def ranked_scan(work: Worklist, name: str = ALL) -> DataFrame:
    """Running records and events along the ranking of one scenario: the full capture curve."""
    rows = work.rows.where(work.member(name))
    sums = {"cum_n": F.col("w"), "cum_event_n": F.col("w") * F.col("y")}
    slices = slices_for(work.hist.agg(F.sum("rows")).first()[0], work.rows_per_task) if work.hist is not None else 0
    return running_totals(rows, list(work.by), rank_order(), sums, slices).select(
        *work.by, "pos", "score", "y", "cum_n", "cum_event_n"
    )


def comparisons(protocols: DataFrame, by: Sequence[str] = ("target",), pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """From / to / delta of every measure for scenario pairs, per group, protocol and share.

    One grouped pivot instead of a self-join: all scenarios of a key meet in one aggregation row. A missing
    scenario fails the query.
    """
    pairs = tuple(pairs) or PAIRS
    names = sorted({n for pair in pairs for n in pair})
    measured = ("eligible_n", "selected_n", "true_positive_n", "precision", "recall_among_eligible",
                "population_event_capture", "event_availability_ceiling")
    keys = [*by, "protocol", "nominal_fraction"]
    packed = F.struct(*measured)
    wide = protocols.groupBy(*keys).agg(*[
        F.max(F.when(F.col("availability_scenario") == n, packed)).alias(f"s{i}") for i, n in enumerate(names)
    ])
    complete = F.lit(True)
    for i in range(len(names)):
        complete = complete & F.col(f"s{i}").isNotNull()
    rows = []
    for a, b in pairs:
        left, right = (F.col(f"s{names.index(n)}") for n in (a, b))
        fields = [F.lit(a).alias("from_scenario"), F.lit(b).alias("to_scenario")]
        for m in measured:
            fields += [left[m].alias(f"from_{m}"), right[m].alias(f"to_{m}")]
            if m not in ("eligible_n", "event_availability_ceiling"):
                fields.append((right[m] - left[m]).alias(f"delta_{m}"))
        rows.append(F.struct(*fields))
    checked = F.when(complete, F.array(*rows)).otherwise(F.raise_error(F.lit("missing scenario in comparison")))
    return wide.select(*keys, F.inline(checked))


def transport(
    work: Worklist, thresholds: DataFrame, fractions: Sequence[float] = FRACTIONS, name: str = ALL, digits: int = 6
) -> DataFrame:
    """Selections of a transported threshold, used exactly and rounded to ``digits`` decimals."""
    by = list(work.by)
    variants = []
    for precision in ("exact", f"rounded_{digits}dp"):
        cut = thresholds if precision == "exact" else thresholds.withColumn("threshold", F.bround("threshold", digits))
        variants.append(threshold_counts(work, cut, fractions).where(F.col("scenario") == name).withColumn(
            "threshold_precision", F.lit(precision)))
    sizes = work.totals.select(*by, F.col("full_n").alias("N_all"), F.col("full_e").alias("E_all"))
    return variants[0].unionByName(variants[1]).join(sizes, by).select(
        *by, "nominal_fraction", "threshold_precision", "threshold", "N_all", "E_all", "selected_n",
        F.col("true_positive_n").alias("TP"),
        ratio(F.col("selected_n"), F.col("N_all")).alias("selection_rate"),
        ratio(F.col("true_positive_n"), F.col("E_all")).alias("population_event_capture"),
        ratio(F.col("true_positive_n"), F.col("selected_n")).alias("precision"),
    )


def workload_difference(transported: DataFrame) -> DataFrame:
    """Realised minus nominal selections of the exact threshold, with the prevalence behind it."""
    nominal = budget(F.col("nominal_fraction"), F.col("N_all"))
    return transported.where(F.col("threshold_precision") == "exact").drop("threshold_precision").withColumns({
        "prevalence": ratio(F.col("E_all"), F.col("N_all")),
        "nominal_selected_n": nominal,
        "workload_difference_n": F.col("selected_n") - nominal,
    })
