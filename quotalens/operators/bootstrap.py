"""Paired bootstrap of selections: full-size resamples as weights on one fixed ranking.

Two samplers of the same law (n draws with replacement from n records, the counts shared by every scenario,
protocol, cell and share of a replicate):

* :func:`resample` draws one uniform per record and replicate from a hash. Every draw is a row, so it costs
  n * replicates rows; it is exactly reproducible anywhere, SQL included.
* :func:`block_bootstrap` draws how many copies fall into each stretch of the ranking instead of which record
  each copy is, and goes down to single records only where a budget runs out. Its cost per replicate does not
  grow with n, apart from one ranking of the population.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import ratio, uniform
from quotalens.names import ALL, EARLY, FIXED_BUDGET, FIXED_THRESHOLD, FRACTIONS, PAIRS, TOP_FRACTION
from quotalens.operators.cohorts import scenarios
from quotalens.operators.decompose import CELLS, add_effects
from quotalens.operators.ranking import Worklist, at_most, ranked, top_b, worklist
from quotalens.operators.selection import budget_requests, threshold_counts
from quotalens.session import ROWS_PER_TASK, materialize
from quotalens.sources.colocated import buckets_for, colocate, dealt_like

#: Most groups whose sizes are broadcast.
MOST_GROUPS = 100_000

#: Effects that get a percentile interval.
INTERVAL_EFFECTS = (
    "shapley_capacity", "shapley_availability", "interaction", "total_topq_contrast", "availability_at_early_budget",
    "ordered_availability_at_all_budget", "capacity_share",
)


def resample(
    population: DataFrame, replicates: int, seed: int, by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The population once per replicate with integer ``w`` >= 1, records not drawn left out.

    Record number i of a group makes draw i of every replicate: it hits the record whose 0-based rank is
    floor(u * n). The ranking is stored in buckets of (by, rank), which both spread the drawing records and meet
    the draws that hit them; so only the draws are exchanged, once. The result is written down because both passes
    of a selection read it.
    """
    by = list(by)
    order = ranked(population, by, rows_per_task=rows_per_task).drop("cum_event_n")
    stored, buckets = _stored_ranking(materialize(order, "ranked"), by, rows_per_task)
    return materialize(_hits(stored, by, replicates, seed, buckets), "resample")


def _stored_ranking(order: DataFrame, by: Sequence[str], rows_per_task: int) -> tuple[DataFrame, int]:
    buckets = buckets_for(order, order.count(), rows_per_task)
    return colocate(order, [*by, "rank"], "ranking", buckets), buckets


def _hits(order: DataFrame, by: Sequence[str], replicates: int, seed: int, buckets: int) -> DataFrame:
    sizes = materialize(order.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    draws = order.select(*by, "rank").join(F.broadcast(sizes) if sizes.count() <= MOST_GROUPS else sizes, by).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    hit = F.floor(uniform(F.lit(seed), *[F.col(c) for c in by], F.col("replicate"), F.col("rank") - 1) * F.col("_n")) + 1
    dealt = dealt_like(draws.select(*by, "replicate", hit.cast("bigint").alias("rank")), [*by, "rank"], buckets)
    counts = dealt.groupBy(*by, "replicate", "rank").agg(F.count(F.lit(1)).alias("w"))
    return counts.hint("merge").join(order, [*by, "rank"]).drop("rank")


def resampled_worklist(weighted: DataFrame, by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK) -> Worklist:
    """The resamples as one worklist whose groups are (group, replicate)."""
    return worklist(weighted, scenarios(), [*by, "replicate"], weight="w", rows_per_task=rows_per_task)


def _positive_events(work: Worklist) -> Column:
    return F.when(F.col("full_e") > 0, F.lit(True)).otherwise(
        F.raise_error(F.lit("a resample has no events")).cast("boolean"))


def cell_tp(work: Worklist, budgets: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """True positives of the four cells per replicate; budgets stay at their observed values.

    ``budgets``: by, ``nominal_fraction``, ``B_early``, ``B_all``. A budget above the resampled candidate count,
    or B_early above B_all, fails the query.
    """
    sized = work.totals.where(_positive_events(work)).join(budgets.select(*by, "nominal_fraction", "B_early", "B_all"), list(by))
    ordered = F.when(F.col("B_early") <= F.col("B_all"), F.col("B_early")).otherwise(
        F.raise_error(F.lit("B_early exceeds B_all")).cast("bigint"))
    asked = []
    for cell, (from_wide, by_wide) in CELLS.items():
        name = ALL if from_wide else EARLY
        size = at_most(F.col("B_all") if by_wide else ordered, work.n(name), cell)
        asked.append(F.struct(F.lit(cell).alias("cell"), F.lit(name).alias("scenario"), size.alias("budget_n")))
    requests = sized.select(
        *by, "replicate", "nominal_fraction", "B_early", "B_all", F.col("full_e").alias("full_event_n"), F.inline(F.array(*asked)))
    return top_b(work, requests).select(
        *by, "replicate", "nominal_fraction", "B_early", "B_all", "full_event_n", "cell", "true_positive_n")


def cell_replicates(tp: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """One row per group, share and replicate: four true-positive counts and all effects."""
    keys = [*by, "nominal_fraction", "replicate", "full_event_n", "B_early", "B_all"]
    wide = tp.groupBy(*keys).agg(*[
        F.max(F.when(F.col("cell") == c, F.col("true_positive_n"))).alias(f"{c}_tp") for c in CELLS
    ])
    captures = {c: ratio(F.col(f"{c}_tp"), F.col("full_event_n")) for c in CELLS}
    return add_effects(wide.withColumns(captures)).drop(*CELLS)


def cell_intervals(replicates: DataFrame, by: Sequence[str] = ("target",), level: float = 0.95) -> DataFrame:
    """Percentile interval of each effect per group and share; replicates with a zero total have no capacity share."""
    tail = (1.0 - level) / 2.0
    rows = replicates.withColumn("capacity_share", ratio(F.col("shapley_capacity"), F.col("total_topq_contrast")))
    pairs = [F.percentile(e, [tail, 1.0 - tail]).alias(f"_{e}") for e in dict.fromkeys((*INTERVAL_EFFECTS, *_REPORT_EFFECTS))]
    wide = rows.groupBy(*by, "nominal_fraction").agg(F.count(F.lit(1)).alias("replicates"), *pairs)
    out = {}
    for e in dict.fromkeys((*INTERVAL_EFFECTS, *_REPORT_EFFECTS)):
        out |= {f"{e}_lower": F.col(f"_{e}")[0], f"{e}_upper": F.col(f"_{e}")[1]}
    return wide.withColumns(out).drop(*[c for c in wide.columns if c.startswith("_")])


_REPORT_EFFECTS = ("availability_main_at_early_budget", "capacity_main_in_early_cohort")


def protocol_counts(
    work: Worklist, thresholds: DataFrame, fractions: Sequence[float] = FRACTIONS, by: Sequence[str] = ("target",)
) -> DataFrame:
    """Selected records and true positives per replicate, protocol, share and scenario.

    The top fraction follows the resampled eligible count; the fixed budget is the share of the full-size
    resample; the threshold stays. ``thresholds``: by, ``nominal_fraction``, ``threshold``.
    """
    keys = [*by, "replicate"]
    checked = work.totals.where(_positive_events(work))
    budgets = budget_requests(work, fractions)
    picked = top_b(work, budgets).select(
        *keys, "protocol", "nominal_fraction", "scenario", F.col("budget_n").alias("selected_n"), "true_positive_n")
    per_replicate = work.totals.select(*keys).join(thresholds, list(by))
    cut = threshold_counts(work, per_replicate, fractions).select(
        *keys, F.lit(FIXED_THRESHOLD).alias("protocol"), "nominal_fraction", "scenario", "selected_n", "true_positive_n")
    events = checked.select(*keys, F.col("full_n").alias("bootstrap_sample_n"), F.col("full_e").alias("bootstrap_event_n"))
    return picked.unionByName(cut).join(events, keys)


def protocol_replicates(counts: DataFrame, by: Sequence[str] = ("target",), pairs: Sequence[tuple[str, str]] = PAIRS) -> DataFrame:
    """From / to / delta of selections, true positives and capture per replicate, protocol, share and pair."""
    keys = [*by, "replicate", "bootstrap_sample_n", "bootstrap_event_n", "protocol", "nominal_fraction"]
    names = sorted({n for pair in pairs for n in pair})
    packed = F.struct(
        "selected_n", "true_positive_n",
        ratio(F.col("true_positive_n"), F.col("bootstrap_event_n")).alias("population_event_capture"),
    )
    wide = counts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("scenario") == n, packed)).alias(f"s{i}") for i, n in enumerate(names)
    ])
    rows = []
    for a, b in pairs:
        left, right = (F.col(f"s{names.index(n)}") for n in (a, b))
        fields = [F.lit(a).alias("from_scenario"), F.lit(b).alias("to_scenario")]
        for m in ("selected_n", "true_positive_n", "population_event_capture"):
            fields += [left[m].alias(f"from_{m}"), right[m].alias(f"to_{m}"), (right[m] - left[m]).alias(f"delta_{m}")]
        rows.append(F.struct(*fields))
    return wide.select(*keys, F.inline(F.array(*rows)))


def protocol_summary(
    replicates: DataFrame, point: DataFrame, by: Sequence[str] = ("target",), level: float = 0.95
) -> DataFrame:
    """Mean, standard error and percentile interval of the deltas next to their point values.

    ``point``: the comparison table of the observed population.
    """
    tail = (1.0 - level) / 2.0
    keys = [*by, "protocol", "nominal_fraction", "from_scenario", "to_scenario"]
    capture, tp, picked = "delta_population_event_capture", "delta_true_positive_n", "delta_selected_n"

    def bounds(c: str) -> Column:
        return F.percentile(F.col(c).cast("double"), [tail, 1.0 - tail])

    summary = replicates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg(capture).alias(f"bootstrap_mean_{capture}"), F.stddev_samp(capture).alias(f"bootstrap_se_{capture}"),
        bounds(capture).alias("_c"), F.avg(tp).alias(f"bootstrap_mean_{tp}"), bounds(tp).alias("_t"),
        F.avg(picked).alias(f"bootstrap_mean_{picked}"),
    )
    observed = point.select(*keys, *[F.col(c).alias(f"point_{c}") for c in (capture, tp, picked)])
    return summary.join(observed, keys).withColumns({
        f"ci_lower_{capture}": F.col("_c")[0], f"ci_upper_{capture}": F.col("_c")[1],
        f"ci_lower_{tp}": F.col("_t")[0], f"ci_upper_{tp}": F.col("_t")[1],
    }).drop("_c", "_t")


def replicate_counts(rows: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Rows and distinct replicates per group, and whether it holds exactly one row per replicate."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("replicate").alias("distinct_replicates")
    ).withColumn("holds", (F.col("rows") == replicates) & (F.col("distinct_replicates") == replicates))


def replicate_check(rows: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Groups that do not hold exactly one row per replicate."""
    return replicate_counts(rows, keys, replicates).where("NOT holds").drop("holds")


# Task bodies below travel by value, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- Block bootstrap -------------------------------------------------------------------------------------------

#: Stretches one stretch is divided into per level, and replicates one task handles.
FAN_OUT = 2000
REPLICATES_PER_TASK = 250


def _generator(seed: int, *parts: object) -> np.random.Generator:
    """A generator fixed by its arguments, so a retried task draws the same numbers."""
    digest = hashlib.blake2b("|".join(map(str, (seed, *parts))).encode(), digest_size=16).digest()
    return np.random.default_rng(int.from_bytes(digest, "little"))


@dataclass(frozen=True)
class Ask:
    """One question asked of every replicate.

    ``kind``: 'column' takes the budget from a column, 'share_of_all' and 'share_of_eligible' from the resampled
    sizes, 'threshold' counts what reaches a cutoff (``cut_bit``) without a budget.
    """

    request: int
    scenario_bit: int
    kind: str
    share: float = 0.0
    column: str = ""
    cut_bit: int = 0


def _draw_roots(keys: Sequence[str], seed: int, replicates: int, asks: Sequence[Ask]):
    """Task body per group and chunk: copies per stratum for each replicate, and from them budgets and counts."""
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        stratum, sizes = pdf["stratum"].to_numpy(), pdf["size"].to_numpy(dtype=np.float64)
        total, label, first = int(pdf["size"].sum()), pdf["stratum"].to_numpy() & 1, pdf.iloc[0]
        start = int(first["chunk"]) * REPLICATES_PER_TASK
        rows = []
        for replicate in range(start, min(replicates, start + REPLICATES_PER_TASK)):
            rng = _generator(seed, *[first[k] for k in keys], replicate, "root")
            copies = rng.multinomial(total, sizes / sizes.sum()).astype(np.int64)
            events = int((copies * label).sum())
            if events == 0:
                raise ValueError("a resample has no events")
            for ask in asks:
                member = (stratum >> ask.scenario_bit) & 1
                eligible = int((copies * member).sum())
                done = 0
                if ask.kind == "threshold":
                    member = member & (stratum >> ask.cut_bit)
                    wanted, need, done = int((copies * member).sum()), 0, int((copies * member * label).sum())
                else:
                    base = total if ask.kind == "share_of_all" else eligible
                    wanted = int(first[ask.column]) if ask.kind == "column" else max(1, int(np.rint(ask.share * base)))
                    need = wanted
                    if wanted > eligible:
                        raise ValueError(f"budget {wanted} exceeds the resampled count {eligible}")
                rows.append((*[first[k] for k in keys], 0, int(first["chunk"]), replicate, ask.request, ask.scenario_bit, wanted,
                             need, done, events, total, stratum.tolist(), copies.tolist()))
        return pd.DataFrame(rows, columns=[*keys, *_REQUEST_COLUMNS])

    return draw


_REQUEST_COLUMNS = ("parent", "chunk", "replicate", "request", "scenario_bit", "budget", "need", "tp_before",
                    "full_event_n", "sample_n", "codes", "copies")
_REQUEST_TYPES = ("parent bigint, chunk int, replicate int, request int, scenario_bit int, budget bigint, need bigint, "
                  "tp_before bigint, full_event_n bigint, sample_n bigint, codes array<int>, copies array<bigint>")


def _descend(keys: Sequence[str], seed: int, level: int):
    """Task body for one parent stretch: move every request of its replicates into one child stretch.

    Units arrive as (child, stratum, size). The stratum code holds the label in bit 0 and memberships above it.
    All requests of a replicate in this stretch share one draw, which keeps the design paired.
    """
    def place(units: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["child", "stratum"], kind="mergesort")
        child, stratum = units["child"].to_numpy(), units["stratum"].to_numpy()
        sizes = units["size"].to_numpy(dtype=np.float64)
        strata = {int(code): np.flatnonzero(stratum == code) for code in np.unique(stratum)}
        label, rows = stratum & 1, []
        for replicate, asked in requests.groupby("replicate", sort=True):
            first = asked.iloc[0]
            rng = _generator(seed, *[first[k] for k in keys], replicate, level, first["parent"])
            given: dict[int, int] = {}
            for code, n in zip(first["codes"], first["copies"]):
                given[int(code)] = given.get(int(code), 0) + int(n)
            copies = np.zeros(len(sizes), dtype=np.int64)
            for code in sorted(given):
                if given[code]:
                    at = strata[code]
                    copies[at] = rng.multinomial(given[code], sizes[at] / sizes[at].sum())
            for r in asked.itertuples(index=False):
                taken = copies * ((stratum >> r.scenario_bit) & 1)
                upto = np.cumsum(taken)
                found = child[int(np.searchsorted(upto, r.need, side="left"))]
                lo, hi = (int(np.searchsorted(child, found, side=s)) for s in ("left", "right"))
                passed = int(upto[lo - 1]) if lo else 0
                events = int((taken[:lo] * label[:lo]).sum())
                rows.append((*[getattr(r, k) for k in keys], int(found), r.chunk, int(replicate), r.request, r.scenario_bit, r.budget,
                             int(r.need) - passed, int(r.tp_before) + events, r.full_event_n, r.sample_n,
                             stratum[lo:hi].tolist(), copies[lo:hi].tolist()))
        return pd.DataFrame(rows, columns=[*keys, *_REQUEST_COLUMNS])

    return place


def stretch_sizes(largest: int, fan_out: int = FAN_OUT) -> list[int]:
    """Stretch lengths per level, down to single records; each is a multiple of the next.

    The fewest levels for which no stretch has more than ``fan_out`` children, with children spread evenly over the
    levels: long last stretches keep the budgets of many replicates in the same few stretches. A stretch lies within
    one longer stretch, so whatever way its requests came, they share its copies.
    """
    levels = max(1, math.ceil(math.log(max(2, largest)) / math.log(fan_out) - 1e-9))
    ratio = max(2, math.ceil(largest ** (1.0 / levels) - 1e-9))
    return [ratio ** level for level in reversed(range(levels))]


def block_bootstrap(
    population: DataFrame,
    members: Mapping[str, Column],
    asks: Sequence[Ask],
    replicates: int,
    seed: int,
    by: Sequence[str] = ("target",),
    constants: DataFrame | None = None,
    cuts: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Answer every ask for every replicate: by, replicate, request, budget, true_positive_n, full_event_n, sample_n.

    A resample is fixed top down. The copies per stratum (label x scenario memberships x cutoffs) are one multinomial;
    inside a stratum the copies spread over stretches of the ranking by another; only the stretch in which a budget
    runs out is divided again, down to records. Each step is the exact conditional law, so the counts have the law of
    n draws with replacement, while the work per replicate is the number of strata and ``fan_out``, whatever n is.

    ``constants``: one row per group with budget and cutoff columns; ``cuts`` names the cutoff columns.
    """
    by = list(by)
    if constants is not None:
        constants = materialize(constants, "constants")
    rows = population.join(constants.select(*by, *cuts), by) if cuts else population
    bits = [*members.values(), *[F.col("score") >= F.col(c) for c in cuts]]
    code = F.col("y").cast("int")
    for i, flag in enumerate(bits, start=1):
        code = code + F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
    coded = rows.select(*by, "pos", (F.col("score").cast("double") + F.lit(0.0)).alias("score"), F.lit(0).alias("y"), code.alias("stratum"))
    order = materialize(ranked(coded, by, rows_per_task=rows_per_task).select(*by, (F.col("rank") - 1).alias("at"), "stratum"), "order")

    strata = order.groupBy(*by, "stratum").agg(F.count(F.lit(1)).alias("size"))
    strata = materialize(strata if constants is None else strata.join(constants, by), "strata")
    largest = strata.groupBy(*by).agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in order.schema if f.name in by)
    schema = f"{key_types}, {_REQUEST_TYPES}"
    chunks = math.ceil(replicates / REPLICATES_PER_TASK)
    chunked = strata.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    roots = materialize(chunked.groupBy(*by, "chunk").applyInPandas(_draw_roots(by, seed, replicates, asks), schema), "roots")

    open_requests, length = roots.where("need > 0"), max(1, largest)
    for level, shorter in enumerate(stretch_sizes(largest, fan_out)):
        wanted = open_requests.select(*by, "parent", F.col("chunk").alias("chunk")).distinct()
        units = order.select(
            *by, F.floor(F.col("at") / length).alias("parent"), F.floor(F.col("at") / shorter).alias("child"), "stratum"
        ).join(wanted.select(*by, "parent").distinct(), [*by, "parent"], "left_semi")
        units = units.groupBy(*by, "parent", "child", "stratum").agg(F.count(F.lit(1)).alias("size"))
        keys = [*by, "parent", "chunk"]
        placed = units.join(wanted, [*by, "parent"]).groupBy(*keys).cogroup(open_requests.groupBy(*keys)).applyInPandas(
            _descend(by, seed, level), schema)
        open_requests, length = materialize(placed, f"level{level}"), shorter

    kept = [*by, "replicate", "request", F.col("budget").alias("budget_n")]
    last_label = F.col("codes")[0].bitwiseAND(1)
    settled = open_requests.select(
        *kept, (F.col("tp_before") + F.col("need") * last_label).cast("bigint").alias("true_positive_n"), "full_event_n", "sample_n")
    counted = roots.where("need = 0").select(*kept, F.col("tp_before").alias("true_positive_n"), "full_event_n", "sample_n")
    return settled.unionByName(counted)


def block_cell_tp(
    population: DataFrame, budgets: DataFrame, replicates: int, seed: int, fractions: Sequence[float] = FRACTIONS,
    by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK, fan_out: int = FAN_OUT,
) -> DataFrame:
    """Same table as :func:`cell_tp`, from block resamples."""
    members = {n: c for n, c in scenarios().items() if n in (EARLY, ALL)}
    wide = budgets.groupBy(*by).agg(*[
        F.max(F.when(F.col("nominal_fraction") == F.lit(float(q)), F.col(b))).alias(f"{b}_{k}")
        for k, q in enumerate(fractions) for b in ("B_early", "B_all")
    ])
    asks, labels = [], []
    for k, q in enumerate(fractions):
        for cell, (from_wide, by_wide) in CELLS.items():
            request, bit = len(asks), 2 if from_wide else 1
            asks.append(Ask(request, bit, "column", column=f"{'B_all' if by_wide else 'B_early'}_{k}"))
            labels.append((request, float(q), cell))
    answers = block_bootstrap(population, members, asks, replicates, seed, by, wide, (), rows_per_task, fan_out)
    named = population.sparkSession.createDataFrame(labels, "request int, nominal_fraction double, cell string")
    return answers.join(F.broadcast(named), "request").join(
        budgets.select(*by, "nominal_fraction", "B_early", "B_all"), [*by, "nominal_fraction"]
    ).select(*by, "replicate", "nominal_fraction", "B_early", "B_all", "full_event_n", "cell", "true_positive_n")


def block_protocol_counts(
    population: DataFrame, thresholds: DataFrame, replicates: int, seed: int, fractions: Sequence[float] = FRACTIONS,
    by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK, fan_out: int = FAN_OUT,
) -> DataFrame:
    """Same table as :func:`protocol_counts`, from block resamples."""
    members = scenarios()
    cuts = [f"cut_{k}" for k in range(len(fractions))]
    wide = thresholds.groupBy(*by).agg(*[
        F.max(F.when(F.col("nominal_fraction") == F.lit(float(q)), F.col("threshold"))).alias(c) for c, q in zip(cuts, fractions)
    ])
    asks, labels = [], []
    for k, q in enumerate(fractions):
        for bit, name in enumerate(members, start=1):
            for protocol, kind in ((TOP_FRACTION, "share_of_eligible"), (FIXED_BUDGET, "share_of_all"), (FIXED_THRESHOLD, "threshold")):
                labels.append((len(asks), protocol, float(q), name))
                asks.append(Ask(len(asks), bit, kind, share=float(q), cut_bit=1 + len(members) + k))
    answers = block_bootstrap(population, members, asks, replicates, seed, by, wide, cuts, rows_per_task, fan_out)
    named = population.sparkSession.createDataFrame(labels, "request int, protocol string, nominal_fraction double, scenario string")
    return answers.join(F.broadcast(named), "request").select(
        *by, "replicate", "protocol", "nominal_fraction", "scenario", F.col("budget_n").alias("selected_n"), "true_positive_n",
        F.col("sample_n").alias("bootstrap_sample_n"), F.col("full_event_n").alias("bootstrap_event_n"))
