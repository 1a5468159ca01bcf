"""Feature preparation fitted on training rows only: exact medians and modes, scaling, one-hot, float32 assembly."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.fields import FEATURE_SETS, forbidden_features
from quotalens.operators.ranking import running_totals, slices_for
from quotalens.session import ROWS_PER_TASK, materialize

#: Categories a one-hot block may have unless the caller allows more; every category is a matrix column.
MOST_CATEGORIES = 1000


@dataclass(frozen=True)
class FeatureParameters:
    """Everything a frozen transform needs: a few numbers per feature, never records."""

    numeric: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    category: str | None = None
    mode: float | None = None
    categories: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        sizes = {len(self.numeric), len(self.medians), len(self.means), len(self.scales)}
        if len(sizes) != 1:
            raise ValueError("medians, means and scales must match the numeric features")
        values = (*self.medians, *self.means, *self.scales, *self.categories)
        if not all(math.isfinite(v) for v in values):
            raise ValueError("feature parameters must be finite")
        if any(s <= 0 for s in self.scales):
            raise ValueError("scales must be positive")
        if self.category is not None and self.mode not in self.categories:
            raise ValueError("the mode must be one of the categories")

    @property
    def columns(self) -> tuple[str, ...]:
        """Names of the assembled matrix columns: numerics first, then the one-hot block."""
        return (*self.numeric, *[f"{self.category}={c:g}" for c in self.categories])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> FeatureParameters:
        raw = json.loads(text)
        return FeatureParameters(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def check_features(features: Sequence[str]) -> None:
    """Refuse features that are known only after the decision point or define the population."""
    leaked = sorted(set(features) & forbidden_features())
    if leaked:
        raise ValueError(f"forbidden features: {leaked}")


def feature_set(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """A named feature list in its fixed order."""
    features = FEATURE_SETS[name]
    check_features(features)
    return df.select(*keep, *features)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct known values per column with their number: ``feature``, ``value``, ``n``. Combined map-side."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot([], list(columns), "feature", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    ).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


#: Share of the ranks on each side of a quantile that its bracket covers, and the accuracy of the sketch that finds it.
MARGIN, ACCURACY = 0.001, 10_000


@dataclass(frozen=True)
class Bracket:
    """Where a quantile of a column lies: between ``low`` and ``high``, with ``below`` of ``known_n`` values under ``low``."""

    known_n: int
    low: float
    high: float
    below: int


def _known(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def quantile_brackets(df: DataFrame, columns: Sequence[str], p: float) -> dict[str, Bracket]:
    """A bracket per column that has known values, in two scans without a shuffle of rows.

    A sketch proposes the bracket and a count confirms it. A column whose proposal misses the quantile gets a bracket of
    everything, so the result never depends on the sketch.
    """
    shares = [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    guess = df.agg(*[F.percentile_approx(_known(c), shares, ACCURACY).alias(c) for c in columns]).first()
    guess = {c: guess[c] for c in columns if guess[c]}
    if not guess:
        return {}
    counts = df.agg(*[m for c, (low, high) in guess.items() for m in (
        F.count(_known(c)).alias(f"n_{c}"), F.count_if(_known(c) < low).alias(f"b_{c}"), F.count_if(_known(c) <= high).alias(f"u_{c}"))]).first()
    out = {}
    for c, (low, high) in guess.items():
        n, below, upto = (counts[f"{k}_{c}"] for k in "nbu")
        place = (n - 1) * p
        sound = below <= math.floor(place) and upto > math.ceil(place)
        out[c] = Bracket(n, low, high, below) if sound else Bracket(n, -math.inf, math.inf, 0)
    return out


def bracketed_values(df: DataFrame, brackets: Mapping[str, Bracket]) -> DataFrame:
    """Distinct values inside the brackets with their number: ``feature``, ``value``, ``n``. Other values are not shuffled."""
    inside = df.select(*[F.when(_known(c).between(b.low, b.high), _known(c)).alias(c) for c, b in brackets.items()])
    return inside.unpivot([], list(brackets), "feature", "value").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))


def exact_quantile(df: DataFrame, columns: Sequence[str], p: float = 0.5, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exact quantile of each column with linear interpolation: ``feature``, ``known_n``, ``quantile``.

    Only the values near the quantile are ordered (:func:`quantile_brackets`); a column without known values gives no row.
    """
    brackets = quantile_brackets(df, columns, p)
    sizes = df.sparkSession.createDataFrame(
        [(c, b.known_n, b.below) for c, b in brackets.items()], "feature string, known_n bigint, below bigint")
    if not brackets:
        return sizes.select("feature", "known_n", F.lit(None).cast("double").alias("quantile"))
    counts = materialize(bracketed_values(df, brackets), "values")
    slices = slices_for(counts.count(), rows_per_task)
    upto = running_totals(counts, ["feature"], [F.col("value").asc()], {"upto": F.col("n")}, slices)
    upto = upto.join(F.broadcast(sizes), "feature").withColumn("upto", F.col("upto") + F.col("below"))
    place = (F.col("known_n") - 1) * F.lit(float(p))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("value")))

    found = upto.groupBy("feature").agg(F.first("known_n").alias("known_n"), at(F.floor(place)).alias("lo"), at(F.ceil(place)).alias("hi"))
    share = place - F.floor(place)
    return found.select("feature", "known_n", (F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("quantile"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest among ties: ``feature``, ``mode``, ``n``."""
    best = value_counts(df, columns).groupBy("feature").agg(
        F.max(F.struct(F.col("n"), (-F.col("value")).alias("negated"))).alias("best"))
    return best.select("feature", (-F.col("best.negated") + F.lit(0.0)).alias("mode"), F.col("best.n").alias("n"))


def fit_features(
    train: DataFrame, numeric: Sequence[str], category: str | None = None, most_categories: int = MOST_CATEGORIES,
) -> FeatureParameters:
    """Medians, means and scales after imputation (population sd, a constant column scales by 1), mode and categories.

    A category column with more than ``most_categories`` values is refused, never cut.
    """
    medians = {r["feature"]: r["quantile"] for r in exact_quantile(train, numeric).collect()}
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(medians[c])) for c in numeric}
    row = train.agg(*[f for c in numeric for f in (F.avg(filled[c]).alias(f"m_{c}"), F.stddev_pop(filled[c]).alias(f"s_{c}"))]).first()
    mode, categories = None, ()
    if category is not None:
        mode = most_frequent(train, [category]).first()["mode"]
        seen = train.select(F.col(category).cast("double").alias("c")).where("c is not null").distinct().limit(most_categories + 1).collect()
        if len(seen) > most_categories:
            raise ValueError(f"{category} has more than {most_categories} categories")
        categories = tuple(sorted(r["c"] for r in seen))
    return FeatureParameters(
        tuple(numeric), tuple(float(medians[c]) for c in numeric), tuple(float(row[f"m_{c}"]) for c in numeric),
        tuple(float(row[f"s_{c}"]) or 1.0 for c in numeric), category, mode, categories,
    )


def transform_features(df: DataFrame, params: FeatureParameters, output: str = "features") -> DataFrame:
    """Add the assembled float32 array: imputed and scaled numerics, then one-hot (unknown category: all zeros).

    A missing column or a text category is refused; an infinite value fails the query.
    """
    wanted = [*params.numeric, *([params.category] if params.category else [])]
    absent = sorted(set(wanted) - set(df.columns))
    if absent:
        raise ValueError(f"missing features: {absent}")
    if params.category and dict(df.dtypes)[params.category] == "string":
        raise TypeError(f"{params.category} must hold numeric codes, not text")

    def known(c: str, fill: float) -> Column:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        checked = F.when(F.abs(v) == F.lit(float("inf")), F.raise_error(F.lit(f"{c} is infinite")).cast("double")).otherwise(v)
        return F.coalesce(checked, F.lit(float(fill)))

    values = [
        ((known(c, m) - F.lit(mean)) / F.lit(scale)).cast("float")
        for c, m, mean, scale in zip(params.numeric, params.medians, params.means, params.scales)
    ]
    if params.category:
        code = known(params.category, params.mode)
        values += [(code == F.lit(k)).cast("float") for k in params.categories]
    return df.withColumn(output, F.array(*values))
