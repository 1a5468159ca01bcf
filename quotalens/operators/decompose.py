"""Four-cell design, ordered decomposition, symmetric Shapley effects and the reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import budget, ratio
from quotalens.names import ALL, EARLY, FIXED_THRESHOLD, FRACTIONS, TOP_FRACTION
from quotalens.operators.ranking import Worklist, at_most, each_fraction, top_b

#: Cell -> (candidate set is the wide one, budget comes from the wide one).
CELLS = {"C00": (False, False), "C10": (True, False), "C01": (False, True), "C11": (True, True)}

#: Effects of eligibility (first cell digit) and capacity (second digit) in terms of the four captures.
EFFECTS = {
    "availability_main_at_early_budget": "C10 - C00",
    "capacity_main_in_early_cohort": "C01 - C00",
    "interaction": "C11 - C10 - C01 + C00",
    "ordered_capacity_within_early_cohort": "C01 - C00",
    "ordered_availability_at_all_budget": "C11 - C01",
    "availability_at_early_budget": "C10 - C00",
    "capacity_in_all_cohort": "C11 - C10",
    "shapley_availability": "0.5D * ((C10 - C00) + (C11 - C01))",
    "shapley_capacity": "0.5D * ((C01 - C00) + (C11 - C10))",
    "total_topq_contrast": "C11 - C00",
}

#: Residuals of the accounting identities; all zero up to rounding.
RESIDUALS = {
    "identity_factorial_error":
        "total_topq_contrast - (availability_main_at_early_budget + capacity_main_in_early_cohort + interaction)",
    "identity_shapley_error": "total_topq_contrast - (shapley_availability + shapley_capacity)",
    "interaction_via_availability_error":
        "interaction - (ordered_availability_at_all_budget - availability_at_early_budget)",
    "interaction_via_capacity_error": "interaction - (capacity_in_all_cohort - ordered_capacity_within_early_cohort)",
}


def add_effects(df: DataFrame) -> DataFrame:
    """Add the ten effects and four residuals to rows with capture columns C00, C10, C01, C11."""
    return df.withColumns({n: F.expr(e) for n, e in EFFECTS.items()}).withColumns({n: F.expr(e) for n, e in RESIDUALS.items()})


def cell_requests(work: Worklist, fractions: Sequence[float] = FRACTIONS, narrow: str = EARLY, wide: str = ALL) -> DataFrame:
    """The four (candidate set, budget) requests per group and share.

    An empty narrow set, a population without events, or a wide budget above the narrow set's size fails the query.
    """
    usable = F.when((work.n(narrow) > 0) & (F.col("full_e") > 0), F.lit(True)).otherwise(
        F.raise_error(F.lit("four cells need a non-empty narrow set and at least one event")).cast("boolean")
    )
    sized = work.totals.where(usable).select(
        *work.by, F.col("full_n").alias("full_population_n"), F.col("full_e").alias("full_population_event_n"),
        *[c.alias(f"{m}_{side}") for side, name in (("narrow", narrow), ("wide", wide)) for m, c in (("n", work.n(name)), ("e", work.e(name)))],
        each_fraction(fractions),
    )
    budgets = sized.withColumns({
        "b_narrow": budget(F.col("nominal_fraction"), F.col("n_narrow")),
        "b_wide": at_most(budget(F.col("nominal_fraction"), F.col("n_wide")), F.col("n_narrow"), f"{narrow}: budget"),
    })
    rows = []
    for cell, (from_wide, by_wide) in CELLS.items():
        side = "wide" if from_wide else "narrow"
        rows.append(F.struct(
            F.lit(cell).alias("cell"), F.lit(wide if from_wide else narrow).alias("scenario"),
            F.lit("all" if by_wide else "early").alias("budget_source"), F.col(f"n_{side}").alias("candidate_n"),
            F.col(f"e_{side}").alias("candidate_event_n"), F.col("b_wide" if by_wide else "b_narrow").alias("budget_n"),
        ))
    return budgets.select(
        *work.by, "nominal_fraction", "full_population_n", "full_population_event_n", F.inline(F.array(*rows)))


def four_cells(work: Worklist, fractions: Sequence[float] = FRACTIONS, narrow: str = EARLY, wide: str = ALL) -> DataFrame:
    """Four rows per group and share: counts, precision, capture, recall and ceiling of each cell."""
    picked = top_b(work, cell_requests(work, fractions, narrow, wide))
    return picked.select(
        *work.by, "nominal_fraction", "cell", F.col("scenario").alias("candidate_set"), "budget_source", "candidate_n",
        "candidate_event_n", "full_population_n", "full_population_event_n", "budget_n",
        F.col("budget_n").alias("selected_n"), "true_positive_n",
        ratio(F.col("true_positive_n"), F.col("budget_n")).alias("precision"),
        ratio(F.col("true_positive_n"), F.col("full_population_event_n")).alias("population_event_capture"),
        ratio(F.col("true_positive_n"), F.col("candidate_event_n")).alias("eligible_recall"),
        ratio(F.col("candidate_event_n"), F.col("full_population_event_n")).alias("event_ceiling"),
    )


def _at(cell: str, column: str) -> Column:
    return F.max(F.when(F.col("cell") == cell, F.col(column)))


def decomposition(cells: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """One row per group and share: counts, budgets, captures, true positives, effects and residuals."""
    wide = cells.groupBy(*by, "nominal_fraction").agg(
        _at("C00", "candidate_n").alias("n_early"), _at("C11", "candidate_n").alias("n_all"),
        _at("C00", "candidate_event_n").alias("event_n_early"), _at("C11", "full_population_event_n").alias("event_n_all"),
        _at("C00", "budget_n").alias("B_early"), _at("C11", "budget_n").alias("B_all"),
        *[_at(c, "population_event_capture").alias(c) for c in CELLS],
        *[_at(c, "true_positive_n").alias(f"{c}_tp") for c in CELLS],
    )
    return add_effects(wide).withColumnsRenamed({
        "C00": "C00_early_Bearly", "C10": "C10_all_Bearly", "C01": "C01_early_Ball", "C11": "C11_all_Ball"
    })


def with_capacity_share(effects: DataFrame) -> DataFrame:
    """Add the share of the total contrast that more selections explain; missing when the total is zero."""
    return effects.withColumn("capacity_share", ratio(F.col("shapley_capacity"), F.col("total_topq_contrast")))


def ordered_decomposition(
    work: Worklist, fractions: Sequence[float] = FRACTIONS, narrow: str = EARLY, wide: str = ALL
) -> DataFrame:
    """Naive effect = availability at the larger budget + capacity inside the narrow cohort."""
    cells = four_cells(work, fractions, narrow, wide).where(F.col("cell") != "C10")
    row = cells.groupBy(*work.by, "nominal_fraction").agg(
        _at("C00", "budget_n").alias("from_cohort_budget_n"), _at("C11", "budget_n").alias("to_cohort_budget_n"),
        _at("C00", "true_positive_n").alias("from_tp_at_from_budget"),
        _at("C01", "true_positive_n").alias("from_tp_at_to_budget"),
        _at("C11", "true_positive_n").alias("to_tp_at_to_budget"),
        *[_at(c, "population_event_capture").alias(c) for c in ("C00", "C01", "C11")],
    )
    return row.select(
        *work.by, "nominal_fraction", F.lit(narrow).alias("from_scenario"), F.lit(wide).alias("to_scenario"),
        "from_cohort_budget_n", "to_cohort_budget_n", "from_tp_at_from_budget", "from_tp_at_to_budget", "to_tp_at_to_budget",
        F.expr("C11 - C00").alias("naive_top_fraction_effect"),
        F.expr("C11 - C01").alias("availability_effect_at_to_budget"),
        F.expr("C01 - C00").alias("capacity_effect_within_from_scenario"),
        F.expr("(C11 - C00) - ((C11 - C01) + (C01 - C00))").alias("identity_error"),
    )


def headline(effects: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Extra selections, shrinkage of the gain at a fixed budget, and capacity monotonicity per row."""
    c00, c10, c01, c11 = (F.col(c) for c in ("C00_early_Bearly", "C10_all_Bearly", "C01_early_Ball", "C11_all_Ball"))
    return effects.select(
        *by, "nominal_fraction",
        (ratio(F.col("B_all"), F.col("B_early")) - 1).alias("extra_selections"),
        (F.lit(1.0) - ratio(c11 - c01, c11 - c00)).alias("gain_shrinkage"),
        (100 * (c10 - c00)).alias("eligibility_pp_at_early_budget"),
        (100 * (c11 - c01)).alias("eligibility_pp_at_all_budget"),
        ((c01 >= c00) & (c11 >= c10) & (F.col("shapley_capacity") >= 0)).alias("capacity_monotone"),
    )


def headline_range(rows: DataFrame) -> DataFrame:
    """Smallest and largest fixed-budget eligibility contrast over all rows, and whether all are monotone."""
    pair = F.array("eligibility_pp_at_early_budget", "eligibility_pp_at_all_budget")
    return rows.agg(
        F.min(F.array_min(pair)).alias("min_eligibility_pp"), F.max(F.array_max(pair)).alias("max_eligibility_pp"),
        F.bool_and("capacity_monotone").alias("all_monotone"), F.count(F.lit(1)).alias("rows"),
    )


def random_benchmark(work: Worklist, fractions: Sequence[float] = FRACTIONS, narrow: str = EARLY, wide: str = ALL) -> DataFrame:
    """Expected cells and capacity share if the ranking carried no information. Needs counts only."""
    n, e = work.n(narrow).cast("double"), work.e(narrow).cast("double")
    rows = []
    for q in fractions:
        few, many = budget(q, work.n(narrow)), budget(q, F.col("full_n"))
        rows.append(F.struct(
            F.lit(float(q)).alias("nominal_fraction"), few.alias("B_early"), many.alias("B_all"),
            (ratio(few, n) * ratio(e, F.col("full_e"))).alias("C00"), ratio(few, F.col("full_n")).alias("C10"),
            (ratio(many, n) * ratio(e, F.col("full_e"))).alias("C01"), ratio(many, F.col("full_n")).alias("C11"),
        ))
    cells = work.totals.select(*work.by, F.inline(F.array(*rows)))
    capacity = F.expr("0.5D * ((C01 - C00) + (C11 - C10))")
    return cells.withColumn("shapley_capacity", capacity).withColumn(
        "random_capacity_share", ratio(F.col("shapley_capacity"), F.expr("C11 - C00"))
    )


def marginal_yield(
    protocols: DataFrame, by: Sequence[str] = ("target",), narrow: str = EARLY, wide: str = ALL
) -> DataFrame:
    """What the added selections bring between two scenarios, by share and by threshold.

    One grouped pivot over the protocol table: every key has at most one row per protocol and scenario.
    """
    def pick(protocol: str, scenario: str, column: str) -> Column:
        here = (F.col("protocol") == protocol) & (F.col("availability_scenario") == scenario)
        return F.max(F.when(here, F.col(column)))

    wanted = {}
    for short, protocol in (("a", TOP_FRACTION), ("c", FIXED_THRESHOLD)):
        for side, scenario in (("from", narrow), ("to", wide)):
            for column in ("selected_n", "true_positive_n", "eligible_n", "population_event_capture"):
                wanted[f"{short}_{side}_{column}"] = pick(protocol, scenario, column)
    wide_row = protocols.groupBy(*by, "nominal_fraction").agg(*[v.alias(k) for k, v in wanted.items()])
    added_n = F.col("a_to_selected_n") - F.col("a_from_selected_n")
    added_e = F.col("a_to_true_positive_n") - F.col("a_from_true_positive_n")
    return wide_row.select(
        *by, "nominal_fraction", added_n.alias("added_selected_n"), added_e.alias("added_event_n"),
        ratio(F.lit(100) * added_e, added_n).alias("events_per_100_added"),
        ratio(F.lit(100) * F.col("c_from_selected_n"), F.col("c_from_eligible_n")).alias("threshold_early_rate_pct"),
        ratio(F.lit(100) * F.col("c_to_selected_n"), F.col("c_to_eligible_n")).alias("threshold_all_rate_pct"),
        ratio(F.col("c_to_selected_n"), F.col("c_from_selected_n")).alias("threshold_workload_ratio"),
        (F.lit(100) * (F.col("c_to_population_event_capture") - F.col("c_from_population_event_capture"))).alias("threshold_capture_gain_pp"),
    )


#: Measures set side by side when two scores are compared: name -> expression in percentage points.
SENSITIVITY = {
    "topq_total": "100 * total_topq_contrast",
    "fixed_budget_early_all": "100 * ordered_availability_at_all_budget",
    "shapley_availability": "100 * shapley_availability",
    "shapley_capacity": "100 * shapley_capacity",
    "interaction": "100 * interaction",
}


def sensitivity(
    base: DataFrame, other: DataFrame, base_name: str, other_name: str, by: Sequence[str] = ("target",),
    contrasts: tuple[DataFrame, DataFrame] | None = None, narrow: str = EARLY, wide: str = ALL,
) -> DataFrame:
    """Two decompositions of the same population under different scores, side by side with differences and ratios.

    ``contrasts``: the comparison tables of both scores, for the contrast at a fixed threshold.
    """
    measures = list(SENSITIVITY)
    if contrasts is not None:
        at_cut = (F.col("protocol") == FIXED_THRESHOLD) & (F.col("from_scenario") == narrow) & (F.col("to_scenario") == wide)
        base, other = (
            df.join(c.where(at_cut).select(*by, "nominal_fraction", "delta_population_event_capture"), [*by, "nominal_fraction"])
            for df, c in zip((base, other), contrasts)
        )
        measures.append("threshold_early_all")

    def side(df: DataFrame, name: str) -> DataFrame:
        cut = [] if contrasts is None else [(100 * F.col("delta_population_event_capture")).alias(f"{name}_threshold_early_all_pp")]
        return df.select(
            *by, "nominal_fraction", *[F.expr(e).alias(f"{name}_{m}_pp") for m, e in SENSITIVITY.items()], *cut,
            ratio(F.col("shapley_capacity"), F.col("total_topq_contrast")).alias(f"{name}_capacity_share"),
        )

    both = side(base, base_name).join(side(other, other_name), [*by, "nominal_fraction"])
    deltas = {
        f"delta_{m}_pp": F.col(f"{other_name}_{m}_pp") - F.col(f"{base_name}_{m}_pp") for m in measures
    }
    ratios = {
        f"{m}_ratio": ratio(F.col(f"{other_name}_{m}_pp"), F.col(f"{base_name}_{m}_pp"))
        for m in ("topq_total", "shapley_availability")
    }
    return both.withColumns(deltas | ratios)


#: Effects that carry an interval in the report.
REPORTED = (
    "total_topq_contrast", "availability_main_at_early_budget", "capacity_main_in_early_cohort", "interaction",
    "shapley_availability", "shapley_capacity", "ordered_availability_at_all_budget",
)


def audit_report(effects: DataFrame, intervals: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Point value and interval of each effect, as shares and in percentage points.

    ``intervals``: by, ``nominal_fraction`` and ``<effect>_lower`` / ``<effect>_upper``.
    """
    rows = effects.join(intervals, [*by, "nominal_fraction"])
    out = [*[F.col(c) for c in by], F.col("nominal_fraction"), F.col("B_early").alias("B_early_point"), F.col("B_all").alias("B_all_point"),
           *[F.col(c) for c in ("C00_early_Bearly", "C10_all_Bearly", "C01_early_Ball", "C11_all_Ball")]]
    for name in REPORTED:
        for source, label in ((name, "point"), (f"{name}_lower", "ci_lower"), (f"{name}_upper", "ci_upper")):
            out += [F.col(source).alias(f"{name}_{label}"), (100 * F.col(source)).alias(f"{name}_{label}_pp")]
    return rows.select(*out)

