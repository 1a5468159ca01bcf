"""Exact ranking, top-B selection and running sums without putting a whole group into one task.

The order is always score descending, then position ascending. Positions are unique within a group, so the
order is total and every result is reproducible.

Three exact plans, chosen by counted sizes:

* up to ``rows_per_task`` rows: one window per group;
* more rows, top-B only: a histogram over score buckets finds the bucket in which each budget runs out, and
  only the rows of those buckets are ordered (two narrow scans, no shuffle of the population);
* a boundary bucket that is itself too large (heavy ties), or a full ranking of a large group: range
  partitioning on (group, score, position) with per-slice offsets, which also splits ties.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalens.functions.numeric import budget, is_finite
from quotalens.session import ROWS_PER_TASK, materialize

#: Most score buckets of one group, and the size of the sketch that finds them.
MOST_BUCKETS, SKETCH_SIZE = 4096, 4096

#: Most slices of one ranking: the sample for their borders and the results of their tasks go to the driver.
MOST_SLICES = 2_000


def finite_score(score: str = "score") -> Column:
    """The score as a double, negative zero as zero. A missing, NaN or infinite score fails the query in every plan."""
    value = F.col(score).cast("double")
    message = F.concat(F.lit("score is not finite: "), F.coalesce(value.cast("string"), F.lit("NULL")))
    return F.when(is_finite(value), value + F.lit(0.0)).otherwise(F.raise_error(message).cast("double"))


def slices_for(rows: int, rows_per_task: int) -> int:
    """Slices that hold ``rows_per_task`` rows on average, ``MOST_SLICES`` at most; 0 where one task is enough.

    Beyond the bound slices grow: their sorts spill, while a sample for ever more borders would not fit the driver.
    """
    return min(MOST_SLICES, math.ceil(rows / rows_per_task)) if rows > rows_per_task else 0


def rank_order() -> list[Column]:
    """Score descending, position ascending."""
    return [F.col("score").desc(), F.col("pos").asc()]


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], slices: int
) -> DataFrame:
    """Add inclusive running sums along ``order`` within each ``by`` group.

    With ``slices`` the rows are range partitioned on (by, order) into that many parts, so a group of any size is cut
    into slices of similar size; slice totals give the offset of each slice and the sums are local to a slice. The
    sliced rows are written down first because slice borders come from a sample and must not change between two reads.
    """
    if not slices:
        local = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(local) for name, value in sums.items()})

    sliced = materialize(
        df.repartitionByRange(slices, *[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    offsets = materialize(
        totals.select(
            *by, "_slice", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]
        ),
        "offsets",
    )
    local = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.join(offsets, [*by, "_slice"])
        .withColumns({n: F.sum(v).over(local) + F.col(f"_off_{n}") for n, v in sums.items()})
        .drop("_slice", *[f"_off_{n}" for n in sums])
    )


def ranked(
    df: DataFrame,
    by: Sequence[str] = ("target",),
    eligible: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every eligible row with its 1-based ``rank`` and the running ``cum_event_n`` along the ranking."""
    rows = (df if eligible is None else df.where(eligible)).withColumn("score", finite_score())
    slices = slices_for(rows.count(), rows_per_task)
    sums = {"rank": F.lit(1), "cum_event_n": F.col("y")}
    out = running_totals(rows, by, rank_order(), sums, slices)
    return out.withColumn("rank", F.col("rank").cast("bigint")).withColumn("cum_event_n", F.col("cum_event_n").cast("bigint"))


def group_cuts(df: DataFrame, by: Sequence[str], rows_per_task: int) -> DataFrame | None:
    """(by, cuts): descending score cut points of every group with more than ``rows_per_task`` rows; None if there is none.

    One mergeable sketch per group, so that groups on different scales get their own buckets of about ``rows_per_task``
    rows, ``MOST_BUCKETS`` at most. All groups together have no more cut points than rows divided by ``rows_per_task``.
    Cut points steer only the balance of the work, never a result.
    """
    sketched = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double("score", F.lit(SKETCH_SIZE)).alias("sketch"))
    large = materialize(sketched.where(F.col("rows") > rows_per_task), "sketches")
    most = large.agg(F.max("rows")).first()[0]
    if most is None:
        return None
    steps = min(MOST_BUCKETS, math.ceil(most / rows_per_task))
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / steps) for i in range(1, steps)]))
    own = F.least(F.lit(steps), F.ceil(F.col("rows") / rows_per_task)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.col("own") - 1), lambda i: F.get("grid", F.round(i * steps / F.col("own")).cast("int") - 1))
    return materialize(
        large.select(*by, own.alias("own"), grid.alias("grid")).select(*by, F.sort_array(F.array_distinct(picked), asc=False).alias("cuts")), "cuts")


def add_bucket(df: DataFrame, by: Sequence[str], cuts: DataFrame | None) -> DataFrame:
    """Add ``_bucket``, the number of the group's cut points above the score: 0 holds the highest scores, ties share a bucket."""
    if cuts is None:
        return df.withColumn("_bucket", F.lit(0))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_BUCKETS.bit_length()))])

    def search(at: Column, step: Column) -> Column:
        return F.when(F.get("cuts", at + step - 1) > F.col("score"), at + step).otherwise(at)

    placed = df.join(F.broadcast(cuts), list(by), "left").withColumn("_bucket", F.aggregate(halves, F.lit(0), search))
    return placed.drop("cuts")


@dataclass(frozen=True)
class Worklist:
    """A scored population prepared for repeated top-B questions.

    ``rows`` holds by, pos, score, y, w, one boolean per scenario and the bucket. ``totals`` has one row per group:
    ``full_n``, ``full_e`` and per scenario ``n<i>``, ``e<i>``. ``hist`` has the same counts per bucket, or is
    None when one window per group is enough. ``stored``: the rows lie on disk by bucket and ``hist`` also has
    ``low`` and ``high``, the scores of each bucket, so that a question names the buckets it reads. Where files hold
    several buckets, ``band`` of them share a directory, ``_band``.
    """

    rows: DataFrame
    by: tuple[str, ...]
    names: tuple[str, ...]
    totals: DataFrame
    hist: DataFrame | None
    rows_per_task: int
    stored: bool = False
    band: int = 0

    def of_buckets(self, wanted: DataFrame) -> DataFrame:
        """The rows of some (by, _bucket); of stored rows, only the files of these buckets are read."""
        keys = wanted.select(*self.by, "_bucket").distinct()
        rows = self.rows
        if self.stored:
            numbers = [r[0] for r in keys.select("_bucket").distinct().collect()]
            rows = rows.where(F.col("_bucket").isin(numbers))
            if self.band:
                rows = rows.where(F.col("_band").isin(sorted({n // self.band for n in numbers})))
        return rows.join(keys, [*self.by, "_bucket"], "left_semi")

    def member(self, name: str) -> Column:
        return F.col(f"in{self.names.index(name)}")

    def n(self, name: str) -> Column:
        return F.col(f"n{self.names.index(name)}")

    def e(self, name: str) -> Column:
        return F.col(f"e{self.names.index(name)}")


def worklist(
    population: DataFrame,
    scenarios: Mapping[str, Column],
    by: Sequence[str] = ("target",),
    weight: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> Worklist:
    """Prepare a population with columns ``by``, ``pos``, ``score``, ``y`` and an optional integer ``weight``.

    Reads only these columns and those the scenarios use. Scores must be finite (:func:`finite_score`).
    """
    by, names = tuple(by), tuple(scenarios)
    rows = scored_rows(population, scenarios, by, weight)
    count = rows.count()
    measures = bucket_measures(len(names))
    if count <= rows_per_task:
        rows = add_bucket(rows, by, None)
        return Worklist(rows, by, names, rows.groupBy(*by).agg(*measures), None, rows_per_task)

    rows = add_bucket(rows, by, group_cuts(rows, by, rows_per_task))
    hist = materialize(rows.groupBy(*by, "_bucket").agg(*measures), "histogram")
    return Worklist(rows, by, names, totals_of(hist, by), hist, rows_per_task)


def scored_rows(population: DataFrame, scenarios: Mapping[str, Column], by: Sequence[str], weight: str | None = None) -> DataFrame:
    """by, pos, score, y, w and one boolean ``in<i>`` per scenario."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    return population.select(
        *by,
        "pos",
        finite_score().alias("score"),
        F.col("y").cast("int").alias("y"),
        w.alias("w"),
        *[member.alias(f"in{i}") for i, member in enumerate(scenarios.values())],
    )


def bucket_measures(scenarios: int) -> list[Column]:
    """Rows, and records and events of everybody and of each scenario."""
    measures = [F.count(F.lit(1)).alias("rows"), F.sum("w").alias("full_n"), F.sum(F.col("w") * F.col("y")).alias("full_e")]
    for i in range(scenarios):
        taken = F.when(F.col(f"in{i}"), F.col("w")).otherwise(F.lit(0))
        measures += [F.sum(taken).alias(f"n{i}"), F.sum(taken * F.col("y")).alias(f"e{i}")]
    return measures


def totals_of(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = [c for c in hist.columns if c not in (*by, "_bucket", "low", "high")]
    return hist.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])


def _bucket_ranges(work: Worklist) -> DataFrame:
    """Long histogram: by, scenario, _bucket, records and events before and inside the bucket."""
    before = Window.partitionBy(*work.by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = {
        f"{m}{i}_before": F.coalesce(F.sum(f"{m}{i}").over(before), F.lit(0))
        for i in range(len(work.names)) for m in ("n", "e")
    }
    parts = F.array(*[
        F.struct(
            F.lit(name).alias("scenario"), F.col(f"n{i}").alias("_n"),
            F.col(f"n{i}_before").alias("_n_before"), F.col(f"e{i}_before").alias("_e_before"),
        )
        for i, name in enumerate(work.names)
    ])
    return work.hist.withColumns(base).select(*work.by, "_bucket", F.col("rows").alias("_rows"), F.inline(parts))


def _answerable(work: Worklist, requests: DataFrame) -> DataFrame:
    """The requests; one that names an unknown group or scenario, or more than the scenario holds, fails the query."""
    held = work.totals.select(*work.by, F.inline(F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.col(f"n{i}").alias("_held")) for i, name in enumerate(work.names)])))
    where = F.concat_ws("/", *[F.col(c).cast("string") for c in (*work.by, "scenario")])
    message = F.concat(F.lit("no boundary for budget "), F.col("budget_n").cast("string"), F.lit(" of "), where)
    sound = F.when(F.col("budget_n") <= F.col("_held"), F.col("budget_n")).otherwise(F.raise_error(message).cast("bigint"))
    return requests.join(held, [*work.by, "scenario"], "left").withColumn("budget_n", sound).select(*requests.columns)


def top_b(work: Worklist, requests: DataFrame, allow_zero: bool = False) -> DataFrame:
    """Answer selection requests exactly.

    ``requests`` has by, ``scenario``, ``budget_n`` and any columns of its own. The result adds
    ``true_positive_n``: events among the first ``budget_n`` records of the scenario's ranking, and
    ``last_score`` / ``last_pos``: the key of the last record selected. With weights a record counts as often
    as its weight, and the last record may be taken in part. A zero budget selects nothing and is answered only
    with ``allow_zero``. Builders of requests check budgets against the scenario's size (:func:`at_most`).
    """
    by = list(work.by)
    requests = _answerable(work, requests)
    if work.hist is None:
        located = requests.withColumns({
            "_bucket": F.lit(0), "_need": F.col("budget_n"), "_e_before": F.lit(0).cast("bigint")
        })
        rows, slices = work.rows, 0
    else:
        located = materialize(
            requests.join(_bucket_ranges(work), [*by, "scenario"]).where(
                (F.col("budget_n") > F.col("_n_before")) & (F.col("budget_n") <= F.col("_n_before") + F.col("_n"))
            ).withColumn("_need", F.col("budget_n") - F.col("_n_before")).drop("_n", "_n_before"),
            "located",
        )
        sizes = located.select(*by, "_bucket", "_rows").distinct().agg(F.max("_rows"), F.sum("_rows")).first()
        slices = slices_for(sizes[1] or 0, work.rows_per_task) if (sizes[0] or 0) > work.rows_per_task else 0
        located = located.drop("_rows")
        rows = work.of_buckets(located)

    sums = {}
    for i in range(len(work.names)):
        taken = F.when(F.col(f"in{i}"), F.col("w")).otherwise(F.lit(0))
        sums |= {f"_r{i}": taken, f"_c{i}": taken * F.col("y")}
    scanned = running_totals(rows, [*by, "_bucket"], rank_order(), sums, slices)
    steps = F.array(*[
        F.when(F.col(f"in{i}"), F.struct(
            F.lit(name).alias("scenario"), F.col(f"_r{i}").alias("_upto"), F.col(f"_c{i}").alias("_events")
        ))
        for i, name in enumerate(work.names)
    ])
    steps = scanned.select(
        *by, "_bucket", F.col("score").alias("last_score"), F.col("pos").alias("last_pos"), "w", "y",
        F.inline(steps),
    ).where(F.col("scenario").isNotNull() & (F.col("w") > 0))
    found = located.join(steps, [*by, "_bucket", "scenario"]).where(
        (F.col("_need") > F.col("_upto") - F.col("w")) & (F.col("_need") <= F.col("_upto"))
    )
    tp = F.col("_e_before") + F.col("_events") - (F.col("_upto") - F.col("_need")) * F.col("y")
    answers = found.select(*requests.columns, tp.cast("bigint").alias("true_positive_n"), "last_score", "last_pos")
    if not allow_zero:
        return answers
    return answers.unionByName(
        requests.where(F.col("budget_n") == 0).withColumn("true_positive_n", F.lit(0).cast("bigint")), allowMissingColumns=True
    )


def each_fraction(fractions: Sequence[float]) -> Column:
    """One row per share, as ``nominal_fraction``."""
    return F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("nominal_fraction")


def at_most(budget: Column, available: Column, label: str) -> Column:
    """The budget, or a failed query where it exceeds what is available."""
    message = F.concat(F.lit(f"{label}: budget "), budget.cast("string"), F.lit(" exceeds "), available.cast("string"))
    return F.when(budget <= available, budget).otherwise(F.raise_error(message).cast("bigint"))


def kth_score(
    population: DataFrame,
    fractions: Sequence[float],
    by: Sequence[str] = ("target",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Cutoff per group and share: the k-th largest score, k = round(share * n) kept within 1..n."""
    return kth_of(worklist(population, {"everybody": F.lit(True)}, by, rows_per_task=rows_per_task), fractions)


def kth_of(work: Worklist, fractions: Sequence[float]) -> DataFrame:
    """The same of a prepared population, over its first scenario, which must hold everybody."""
    by = work.by
    requests = work.totals.select(
        *by, F.col("full_n").alias("calibration_n"), F.lit(work.names[0]).alias("scenario"), each_fraction(fractions)
    ).withColumn("budget_n", F.least(budget(F.col("nominal_fraction"), F.col("calibration_n")), F.col("calibration_n")))
    return top_b(work, requests).select(
        *by, "nominal_fraction", "calibration_n", F.col("budget_n").alias("nominal_selected_n"),
        F.col("last_score").alias("threshold"),
    )
