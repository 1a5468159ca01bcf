"""Populations, entry groups and eligibility scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import uniform
from quotalens.names import ALL, ANY, EARLY, LATER, NONE, UNKNOWN


def entry_group(entry: str = "entry") -> Column:
    """The one group a record belongs to: early 1-3, later 4-10, none 0, unknown NULL."""
    e = F.col(entry)
    return (
        F.when(e.isNull(), UNKNOWN)
        .when(e == 0, NONE)
        .when(e.between(1, 3), EARLY)
        .when(e.between(4, 10), LATER)
        .otherwise(F.raise_error(F.lit("entry value outside 0..10")).cast("string"))
    )


def scenarios(entry: str = "entry") -> dict[str, Column]:
    """The three nested candidate sets: early, any entry, everybody."""
    e = F.col(entry)
    return {
        EARLY: F.coalesce(e.between(1, 3), F.lit(False)),
        ANY: F.coalesce(e.between(1, 10), F.lit(False)),
        ALL: F.lit(True),
    }


def flow_scenarios(entry: str = "entry") -> dict[str, Column]:
    """All six groups of the cohort flow: the nested sets and the parts they are made of."""
    e, nested = F.col(entry), scenarios(entry)
    return {
        EARLY: nested[EARLY],
        LATER: F.coalesce(e.between(4, 10), F.lit(False)),
        ANY: nested[ANY],
        NONE: F.coalesce(e == 0, F.lit(False)),
        UNKNOWN: e.isNull(),
        ALL: nested[ALL],
    }


def primary_population(df: DataFrame, resident: str = "is_us_resident", singleton: str = "is_singleton") -> DataFrame:
    """Resident singleton records."""
    return df.where((F.col(resident) == 1) & (F.col(singleton) == 1))


def by_target(df: DataFrame, targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per record and target with a known label: columns ``target``, ``y`` and ``keep``."""
    known = df.select(*keep, *[F.col(t).cast("int").alias(t) for t in targets])
    return known.unpivot(list(keep), list(targets), "target", "y").where(F.col("y").isNotNull())


def cohort_flow(df: DataFrame, by: Sequence[str] = ("target",), groups: Mapping[str, Column] | None = None) -> DataFrame:
    """Records and events per group and scenario, counted in one pass with map-side combining."""
    groups = groups or flow_scenarios()
    event = F.col("y") == 1
    counts = []
    for i, member in enumerate(groups.values()):
        counts += [F.count_if(member).alias(f"n{i}"), F.count_if(member & event).alias(f"e{i}")]
    wide = df.groupBy(*by).agg(*counts)
    rows = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.col(f"n{i}").alias("n_records"), F.col(f"e{i}").alias("event_n"))
        for i, name in enumerate(groups)
    ])
    return wide.select(*by, F.inline(rows))


#: Sums that must hold in a cohort flow: whole -> its disjoint parts.
FLOW_IDENTITIES = {ANY: (EARLY, LATER), ALL: (ANY, NONE, UNKNOWN)}


def flow_identities(flow: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """One row per group and identity with both sides for records and events, and whether they agree."""
    names = sorted({n for whole, parts in FLOW_IDENTITIES.items() for n in (whole, *parts)})
    wide = flow.groupBy(*by).agg(*[
        F.sum(F.when(F.col("scenario") == n, F.col(m))).alias(f"{n}.{m}") for n in names for m in ("n_records", "event_n")
    ])
    rows = []
    for whole, parts in FLOW_IDENTITIES.items():
        for m in ("n_records", "event_n"):
            total = sum((F.col(f"`{p}.{m}`") for p in parts[1:]), F.col(f"`{parts[0]}.{m}`"))
            rows.append(F.struct(
                F.lit(whole).alias("whole"), F.lit(m).alias("measure"),
                F.col(f"`{whole}.{m}`").alias("whole_n"), total.alias("parts_n"),
                (F.col(f"`{whole}.{m}`") == total).alias("holds"),
            ))
    return wide.select(*by, F.inline(F.array(*rows)))


def split_calibration(df: DataFrame, seed: int, fraction: float = 0.2, pos: str = "pos") -> DataFrame:
    """Add boolean ``calibration``: a seeded share of the records, fixed by position alone.

    Every target sees the same split because it does not depend on the target.
    """
    return df.withColumn("calibration", uniform(F.lit(seed), F.col(pos)) < F.lit(float(fraction)))
