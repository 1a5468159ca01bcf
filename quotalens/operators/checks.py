"""Checks as tables: what was counted, what is wrong, and a guard that fails on any violation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import budget, clamped_budget, is_finite
from quotalens.names import ALL, ANY, AVAILABLE, EARLY, FIXED_BUDGET, FIXED_THRESHOLD, POPULATION, TOP_FRACTION


def require(violations: DataFrame, label: str, shown: int = 20) -> None:
    """Fail when the table has rows; the message carries the first few."""
    first = violations.take(shown)
    if first:
        raise ValueError(f"{label}: " + "; ".join(str(r.asDict()) for r in first))


def binary_check(df: DataFrame, columns: Sequence[str], allow_missing: bool) -> DataFrame:
    """Per column: missing (or non-numeric), non-binary values, and whether it passes."""
    sums = []
    for c in columns:
        v = F.col(c).try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
        sums += [F.count_if(v.isNull()).alias(f"m_{c}"), F.count_if(~v.isin(0.0, 1.0)).alias(f"b_{c}")]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing_n"), F.col(f"b_{c}").alias("nonbinary_n"),
            ((F.col(f"b_{c}") == 0) & (F.lit(allow_missing) | (F.col(f"m_{c}") == 0))).alias("valid"),
        )
        for c in columns
    ])
    return df.agg(*sums).select(F.inline(rows))


def _entry_faults(entry: str):
    e = F.col(entry).cast("double")
    outside = is_finite(e) & ((e < 0) | (e > 10))
    fractional = is_finite(e) & (e != F.rint(e))
    return is_finite(e), outside, fractional


def entry_check(df: DataFrame, by: Sequence[str] = (), entry: str = "entry") -> DataFrame:
    """Known values, values outside 0..10 and fractional values per group, and whether the column passes."""
    known, outside, fractional = _entry_faults(entry)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("known_n"),
        F.count_if(outside).alias("outside_n"), F.count_if(fractional).alias("fractional_n"),
    ).withColumn("valid", (F.col("known_n") > 0) & (F.col("outside_n") == 0) & (F.col("fractional_n") == 0))


def entry_violations(df: DataFrame, keep: Sequence[str] = ("pos",), entry: str = "entry") -> DataFrame:
    """The offending rows themselves."""
    _, outside, fractional = _entry_faults(entry)
    return df.where(outside | fractional).select(*keep, entry)


def score_check(df: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Rows and non-finite scores per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~is_finite(F.col("score"))).alias("nonfinite_n")
    ).withColumn("valid", F.col("nonfinite_n") == 0)


def position_check(df: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Positions that occur more than once in a group; the ranking needs them unique."""
    return df.groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def guards(
    df: DataFrame, binary: Sequence[str] = (), allow_missing: bool = True, entry: str | None = None, score: str | None = None,
) -> dict[str, Column]:
    """Counts of violations by the rules of the checks above, as aggregates that a write can observe. Zero means sound."""
    out = {}
    for c in binary:
        v = F.col(c).try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
        bad = F.coalesce(~v.isin(0.0, 1.0), F.lit(not allow_missing))
        out[f"{c} is not binary"] = F.count_if(bad)
    if entry is not None:
        _, outside, fractional = _entry_faults(entry)
        out[f"{entry} is outside 0..10"] = F.count_if(outside)
        out[f"{entry} is fractional"] = F.count_if(fractional)
    if score is not None:
        out[f"{score} is not finite"] = F.count_if(~F.coalesce(is_finite(F.col(score)), F.lit(False)))
    return out


def _report(df: DataFrame, keys: Sequence[str], checks: dict) -> DataFrame:
    """Checks as rows (keys, check, holds)."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in checks.items()])
    return df.select(*keys, F.inline(rows))


def protocol_invariants(protocols: DataFrame, by: Sequence[str] = ("target",), fractions: int = 2) -> DataFrame:
    """The rules a three-protocol table must obey, one row per group and rule."""
    p, s, q = F.col("protocol"), F.col("availability_scenario"), F.col("nominal_fraction")
    own, common, cut = p == TOP_FRACTION, p == FIXED_BUDGET, p == FIXED_THRESHOLD
    per_share = protocols.groupBy(*by, "nominal_fraction").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("full_population_n").alias("n0"), F.max("full_population_n").alias("n1"),
        F.min("full_population_event_n").alias("e0"), F.max("full_population_event_n").alias("e1"),
        F.bool_and(F.when(own, F.col("selected_n") == budget(q, F.col("eligible_n")))).alias("own_exact"),
        F.count_distinct(F.when(common, F.col("selected_n"))).alias("common_sizes"),
        F.bool_and(F.when(common, F.col("selected_n") == F.col("budget_n"))).alias("common_exact"),
        F.count_distinct(F.when(cut, F.col("threshold"))).alias("cuts"),
        *[F.max(F.when(common & (s == name), F.col("event_availability_ceiling"))).alias(f"c_{i}") for i, name in enumerate((EARLY, ANY, ALL))],
    )
    whole = per_share.groupBy(*by).agg(
        F.sum("rows").alias("rows"), (F.min("n0") == F.max("n1")).alias("same_n"), (F.min("e0") == F.max("e1")).alias("same_e"),
        F.bool_and("own_exact").alias("own"), F.bool_and((F.col("common_sizes") == 1) & F.col("common_exact")).alias("common"),
        F.bool_and(F.col("cuts") == 1).alias("cut"),
        F.bool_and((F.col("c_0") <= F.col("c_1")) & (F.col("c_1") <= F.col("c_2"))).alias("nested"),
        F.bool_and(F.abs(F.col("c_2") - 1.0) <= 1e-15).alias("full"),
    )
    return _report(whole, by, {
        "row_count": F.col("rows") == 9 * fractions,
        "population_constant": F.col("same_n"),
        "events_constant": F.col("same_e"),
        "top_fraction_exact": F.col("own"),
        "fixed_budget_common": F.col("common"),
        "threshold_common": F.col("cut"),
        "ceilings_nested": F.col("nested"),
        "full_ceiling_is_one": F.col("full"),
    })


def identity_violations(effects: DataFrame, residuals: Sequence[str], keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Residuals above the tolerance, one row each."""
    rows = F.array_compact(F.array(*[
        F.when(F.abs(F.col(r)) > F.lit(tolerance), F.struct(F.lit(r).alias("residual"), F.col(r).cast("double").alias("value")))
        for r in residuals
    ]))
    return effects.select(*keys, F.inline(rows))


def identity_summary(effects: DataFrame, residuals: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Largest absolute residual per identity and whether it stays within the tolerance."""
    wide = effects.agg(F.count(F.lit(1)).alias("rows"), *[F.max(F.abs(F.col(r))).alias(r) for r in residuals])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("residual"), F.col("rows"), (F.col(r) <= F.lit(tolerance)).alias("holds")) for r in residuals
    ])))


def grid_invariants(protocols: DataFrame, comparisons: DataFrame, effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules of a condition grid, one row per rule with the number of groups that break it."""
    p, s, q = F.col("protocol"), F.col("scenario"), F.col("nominal_fraction")
    everybody, subset = s == POPULATION, s == AVAILABLE
    groups = protocols.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("full_population_event_n").alias("denominators"),
        F.count_distinct(F.when(subset, F.col("eligible_n"))).alias("subset_sizes"),
        F.bool_and(F.when(everybody, F.col("eligible_n") == F.col("full_population_n"))).alias("everybody_is_n"),
        F.bool_and(F.when(p == TOP_FRACTION, F.col("selected_n") == clamped_budget(q, F.col("eligible_n")))).alias("own"),
        F.bool_and(F.when(p == FIXED_BUDGET, F.col("selected_n") == clamped_budget(q, F.col("full_population_n")))).alias("common"),
        F.count_distinct(F.when(p == FIXED_THRESHOLD, F.col("threshold"))).alias("cuts"),
        F.count_if((p == FIXED_THRESHOLD) & F.col("threshold").isNull()).alias("no_cut"),
    )
    tallies = groups.agg(
        F.count_if(F.col("rows") != 6).alias("six_protocol_rows"),
        F.count_if(F.col("denominators") != 1).alias("events_constant"),
        F.count_if(F.col("subset_sizes") != 1).alias("subset_size_constant"),
        F.count_if(~F.col("everybody_is_n")).alias("population_is_everybody"),
        F.count_if(~F.col("own")).alias("top_fraction_exact"),
        F.count_if(~F.col("common")).alias("fixed_budget_exact"),
        F.count_if((F.col("cuts") != 1) | (F.col("no_cut") > 0)).alias("threshold_common"),
    )
    paired = comparisons.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count_if(F.col("rows") != 3).alias("three_comparison_rows"))
    tolerance = F.lit(1e-12)
    sums = effects.agg(
        F.count_if(F.col("tp_identity_error") != 0).alias("tp_identity"),
        F.count_if(F.col("tp_factorial_identity_error") != 0).alias("tp_factorial_identity"),
        F.count_if(F.abs("identity_error") > tolerance).alias("ordered_identity"),
        F.count_if(F.abs("factorial_identity_error") > tolerance).alias("factorial_identity"),
        F.count_if(F.abs("shapley_identity_error") > tolerance).alias("shapley_identity"),
        F.count_if(F.abs(
            F.col("distortion_top_fraction_minus_fixed_budget") - F.col("capacity_effect_within_available_subset")
        ) > tolerance).alias("distortion_is_capacity"),
    )

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("check"), F.col(c).alias("broken_groups")) for c in df.columns
        ])))

    return long(tallies).unionByName(long(paired)).unionByName(long(sums))
