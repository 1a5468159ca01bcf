"""Resamples as packed draws: the hash draws of :func:`quotalens.operators.bootstrap.resample` without a row per draw.

A task makes the draws of a replicate, or of a part of it, with numpy, and writes for every stretch of the ranking which of its
records were hit, a byte a draw. The stretches then meet their records, which are packed too, and are counted into steps, the
buckets of a :class:`Worklist`. Only steps in which a budget or threshold falls are resolved into weighted records.

:func:`in_waves` asks its question of a few replicates at a time and drops their draws before it makes the next ones, so that
what lies on disk grows with the population, not with the number of replicates.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.operators.ranking import Worklist, ranked, scored_rows, totals_of
from quotalens.session import ROWS_PER_TASK, materialize, run_scope, shared_folder, shuffle_width, shuffles_dropped

#: Records of a stretch (65,536 at most, as offsets take two bytes) and of a step, which divides it.
STRETCH, STEP = 1 << 16, 1 << 11

#: Draws made at once, and replicates of a stretch that one task counts.
DRAWS, REPLICATES_TOGETHER = 4_000_000, 100

#: Draws of one wave, a replicate at least, and those that one task of its exchange reads: a byte each, twice on disk.
WAVE, DRAWS_PER_TASK = 3_000_000_000, 64_000_000

#: Last digits that vary among numbers hashed at once.
DIGITS = 5

# Task bodies travel by value, so executors need numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(state: Sequence, words: Sequence, length: int) -> list:
    """MD5 of one block for ``length`` messages at once; a word all messages share is a number, others are arrays."""
    a, b, c, d = state
    free, other = [np.empty(length, dtype=np.uint32) for _ in range(5)], np.empty(length, dtype=np.uint32)
    own = {id(x) for x in free}
    for i in range(64):
        g = (i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16]
        word, s = words[g] + np.uint32(_SINES[i]), np.uint32(_SHIFTS[i])
        if any(np.ndim(x) for x in (a, b, c, d, word)):
            mixed = free.pop()
            if i < 16:
                np.bitwise_xor(c, d, out=mixed)
                np.bitwise_and(mixed, b, out=mixed)
                np.bitwise_xor(mixed, d, out=mixed)
            elif i < 32:
                np.bitwise_xor(b, c, out=mixed)
                np.bitwise_and(mixed, d, out=mixed)
                np.bitwise_xor(mixed, c, out=mixed)
            elif i < 48:
                np.bitwise_xor(b, c, out=mixed)
                np.bitwise_xor(mixed, d, out=mixed)
            else:
                np.invert(d, out=mixed)
                np.bitwise_or(mixed, b, out=mixed)
                np.bitwise_xor(mixed, c, out=mixed)
            if np.ndim(a):
                np.add(mixed, a, out=mixed)
            else:
                word = word + a
            np.add(mixed, word, out=mixed)
            np.right_shift(mixed, np.uint32(32) - s, out=other)
            np.left_shift(mixed, s, out=mixed)
            np.bitwise_or(mixed, other, out=mixed)
            np.add(mixed, b, out=mixed)
            if id(a) in own:
                free.append(a)
        else:
            mixed = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | ~d))[i // 16] + a + word
            mixed = b + ((mixed << s) | (mixed >> (np.uint32(32) - s)))
        a, d, c, b = d, c, b, mixed
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _last_digits() -> list[np.ndarray]:
    """The last, last but one and further digits of all runs' numbers, as characters."""
    numbers = np.arange(10 ** DIGITS)
    return [(numbers // 10 ** k % 10 + 48).astype(np.uint32) for k in range(DIGITS)]


def _digests(prefix: str, first: int, last: int, digits: Sequence[np.ndarray]):
    """The first two words of the MD5 of ``prefix|i`` for i from ``first`` up to ``last``, in runs that differ in their last digits only."""
    at = first
    while at < last:
        varying = min(len(str(at)), DIGITS)
        base = at // 10 ** varying * 10 ** varying
        end = min(last, base + 10 ** varying)
        head = f"{prefix}|{base // 10 ** varying if base else ''}".encode()
        length = len(head) + varying
        shared = np.zeros(-(-(length + 9) // 64) * 64, dtype=np.uint8)
        shared[: len(head)] = np.frombuffer(head, dtype=np.uint8)
        shared[length] = 0x80
        shared[-8:] = np.frombuffer((8 * length).to_bytes(8, "little"), dtype=np.uint8)
        shared = shared.view("<u4")
        run, words = slice(at - base, end - base), list(shared)
        for k in range(varying):
            place = length - 1 - k
            words[place // 4] = words[place // 4] + (digits[k][run] << np.uint32(8 * (place % 4)))
        state = [np.uint32(x) for x in _START]
        for block in range(0, len(words), 16):
            state = _md5_block(state, words[block:block + 16], end - at)
        yield state[0], state[1]
        at = end


def _fractions(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """52 bits of an MD5 as whole doubles."""
    return high.byteswap().astype(np.float64) * float(1 << 20) + (low.byteswap() >> np.uint32(12))


def uniforms(prefix: str, first: int, last: int) -> np.ndarray:
    """``functions.numeric.uniform(prefix, i)`` for i from ``first`` up to ``last``."""
    with np.errstate(over="ignore"):
        return np.concatenate([_fractions(*words) / float(1 << 52) for words in _digests(prefix, first, last, _last_digits())])


def hits(prefix: str, first: int, last: int, size: int, digits: Sequence[np.ndarray]) -> np.ndarray:
    """floor(uniform * size) of the same numbers. Dividing by a power of two is exact, so the product is rounded as that of the uniform."""
    out, at = np.empty(last - first, dtype=np.int32 if size < 1 << 31 else np.int64), 0
    with np.errstate(over="ignore"):
        for words in _digests(prefix, first, last, digits):
            found = _fractions(*words)
            found *= float(size) / float(1 << 52)
            out[at:at + len(found)] = found  # cut off, and none is negative
            at += len(found)
    return out


def _draw(keys: Sequence[str], stretch: int):
    """Task body: the records hit by the draws of one row, packed per stretch as the gaps between sorted offsets."""
    def draw(batches):
        digits = _last_digits()
        for batch in batches:
            for row in batch.itertuples(index=False):
                hit = hits(row.prefix, row.first, row.last, row.size, digits)
                hit.sort()
                numbers = np.arange(int(hit[0]) // stretch, int(hit[-1]) // stretch + 1)
                ends = np.searchsorted(hit, (numbers + 1) * stretch)
                begins, gaps = np.append(0, ends[:-1]), np.diff(hit, prepend=0)
                taken = ends > begins
                gaps[begins[taken]] = hit[begins[taken]] - numbers[taken] * stretch
                out = [(*[getattr(row, k) for k in keys], int(n), _packed(gaps[lo:hi]))
                       for n, lo, hi in zip(numbers[taken], begins[taken], ends[taken])]
                yield pd.DataFrame(out, columns=[*keys, "_stretch", "packet"])

    return draw


def _packed(gaps: np.ndarray) -> bytes:
    """A byte a gap, or two where one is larger; the first byte says how many."""
    return b"\1" + gaps.astype("u1").tobytes() if gaps.max() < 256 else b"\2" + gaps.astype("<u2").tobytes()


def _offsets(packet: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packet, dtype="u1" if packet[0] == 1 else "<u2", offset=1), dtype=np.int64)


def _pack(keys: Sequence[str], scenarios: int, step: int):
    """Task body: the records of one stretch as one row, their labels and memberships packed, and the scores at the ends of its steps."""
    def pack(records: pd.DataFrame) -> pd.DataFrame:
        records, first = records.sort_values("at", kind="mergesort"), records.iloc[0]
        y, score = records["y"].to_numpy(dtype="<i4"), records["score"].to_numpy()
        members = [np.packbits((records[f"in{i}"] == True).to_numpy(dtype=bool)).tobytes()  # noqa: E712 (an unknown membership is none)
                   for i in range(scenarios)]
        return pd.DataFrame([(*[first[k] for k in keys], first["_stretch"], len(y), zlib.compress(y.tobytes(), 1), members,
                              score[::step], score[np.minimum(np.arange(0, len(y), step) + step, len(y)) - 1])],
                            columns=[*keys, "_stretch", "held", "labels", "members", "highs", "lows"])

    return pack


_PACKED_TYPES = "_stretch bigint, held bigint, labels binary, members array<binary>, highs array<double>, lows array<double>"


def _count(keys: Sequence[str], scenarios: int, stretch: int, step: int):
    """Task body for one stretch: its records' weights in each replicate, added up per step."""
    def count(packets: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
        if not len(packets):
            return pd.DataFrame(columns=_columns(keys, scenarios))
        first, stored = packets.iloc[0], records.iloc[0]
        held = int(stored["held"])
        steps = -(-held // step)
        width = steps * step
        y = np.frombuffer(zlib.decompress(stored["labels"]), dtype="<i4").astype(np.float64)
        measures = [np.ones_like(y), y]
        for packed in stored["members"]:
            member = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=held).astype(np.float64)
            measures += [member, member * y]
        table = np.zeros((width, len(measures)))
        table[:held] = np.stack(measures, axis=1)
        table = table.reshape(steps, step, len(measures))
        high, low = np.asarray(stored["highs"]), np.asarray(stored["lows"])
        own = packets.groupby("replicate", sort=True)["packet"]
        names, weights = [], np.empty((len(own), steps, step))
        for i, (replicate, some) in enumerate(own):
            names.append(replicate)
            weights[i] = np.bincount(np.concatenate([_offsets(p) for p in some]), minlength=width).reshape(steps, step)
        sums = np.rint(np.matmul(weights.transpose(1, 0, 2), table)).astype(np.int64)
        s, r = np.nonzero(sums[:, :, 0])
        picked = sums[s, r]
        columns = [first["_stretch"] * (stretch // step) + s, np.count_nonzero(weights, axis=2)[r, s], weights.max(axis=2)[r, s].astype(np.int64),
                   high[s], low[s], *picked.T]
        out = dict(zip(_columns([], scenarios)[1:], columns))
        return pd.DataFrame({**{k: [first[k]] * len(s) for k in keys}, "replicate": np.asarray(names)[r], **out})[_columns(keys, scenarios)]

    return count


def _columns(keys: Sequence[str], scenarios: int) -> list[str]:
    return [*keys, "replicate", "_bucket", "rows", "largest_w", "high", "low", "full_n", "full_e",
            *[f"{m}{i}" for i in range(scenarios) for m in ("n", "e")]]


def _resolve(keys: Sequence[str], stretch: int, step: int):
    """Task body: the draws that hit wanted steps, counted per record."""
    def frame(rows, found):
        times = [len(at) for at, _ in found]
        out = pd.DataFrame({k: np.repeat(np.array([row[k] for row in rows], dtype=object), times) for k in keys})
        return out.assign(at=np.concatenate([at for at, _ in found]), w=np.concatenate([w for _, w in found]))

    def resolve(batches):
        for batch in batches:
            rows, found, records = [], [], 0
            for row in batch.itertuples(index=False):
                row = row._asdict()
                start, wanted = int(row["stretch_no"]) * stretch, np.zeros(stretch // step, dtype=bool)
                wanted[np.asarray(row["wanted"]) - start // step] = True
                offsets = _offsets(row["packet"])
                w = np.bincount(offsets[wanted[offsets // step]], minlength=1)
                at = np.flatnonzero(w)
                rows, found, records = [*rows, row], [*found, (at + start, w[at])], records + len(at)
                if records > stretch or len(rows) == 100:
                    yield frame(rows, found)
                    rows, found, records = [], [], 0
            if rows:
                yield frame(rows, found)

    return resolve


@dataclass(frozen=True)
class Draws(Worklist):
    """Resamples as a worklist of (group, replicate) whose buckets are steps of the ranking; ``rows`` is the ranking itself."""

    packets: DataFrame | None = None
    counts: DataFrame | None = None
    stretch: int = STRETCH
    step: int = STEP

    def of_buckets(self, wanted: DataFrame) -> DataFrame:
        group = [c for c in self.by if c != "replicate"]
        keys = materialize(wanted.select(*self.by, "_bucket").distinct(), "wanted")
        per_packet = keys.groupBy(*self.by, F.expr(f"_bucket div {self.stretch // self.step}").alias("_stretch")).agg(
            F.collect_list("_bucket").alias("wanted"))
        asked = self.packets.join(per_packet, [*self.by, "_stretch"]).withColumnRenamed("_stretch", "stretch_no")
        types = _types(self.packets, self.by)
        hits = asked.mapInPandas(_resolve(self.by, self.stretch, self.step), f"{types}, at bigint, w bigint")
        weights = hits.groupBy(*self.by, "at").agg(F.sum("w").alias("w"))
        records = self.rows.join(F.broadcast(keys.select(*group, "_bucket").distinct()), [*group, "_bucket"], "left_semi")
        return weights.join(records, [*group, "at"])


def _types(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


@dataclass(frozen=True)
class Ranking:
    """A ranked population as the draws meet it: ``rows`` by rank, ``stretches`` of packed records and the ``sizes`` of the groups."""

    rows: DataFrame
    stretches: DataFrame
    sizes: DataFrame
    records: int
    parts: int
    by: tuple[str, ...]
    names: tuple[str, ...]
    rows_per_task: int
    stretch: int
    step: int
    draws: int


def ranking(
    population: DataFrame, scenarios: Mapping[str, Column], by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK,
    stretch: int = STRETCH, step: int = STEP, draws: int = DRAWS,
) -> Ranking:
    """Rank a population for its draws; what the ranking itself writes on the way is dropped."""
    by, names, spark = list(by), tuple(scenarios), population.sparkSession
    members, folder = [f"in{i}" for i in range(len(names))], shared_folder(spark)
    with run_scope(spark), shuffles_dropped(spark):
        plain = ranked(scored_rows(population, scenarios, by).drop("w"), by, rows_per_task=rows_per_task)
        rows = materialize(plain.select(
            *by, (F.col("rank") - 1).alias("at"), F.expr(f"(rank - 1) div {step}").alias("_bucket"), "pos", "score", "y", *members),
            "ranked", folder)
        sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size")), "sizes", folder)
        records, parts = (x or 0 for x in sizes.agg(F.sum("size"), F.sum(F.ceil(F.col("size") / draws))).first())
        dealt = rows.select(*by, F.expr(f"at div {stretch}").alias("_stretch"), "at", "score", "y", *members).repartition(
            max(shuffle_width(rows), math.ceil(records / rows_per_task)), *by, "_stretch")
        stretches = materialize(
            dealt.groupBy(*by, "_stretch").applyInPandas(_pack(by, len(names), step), f"{_types(rows, by)}, {_PACKED_TYPES}"),
            "stretches", folder)
    return Ranking(rows, stretches, sizes, records, parts, tuple(by), names, rows_per_task, stretch, step, draws)


def _drawn(order: Ranking, start: int, stop: int, seed: int) -> Draws:
    """The replicates from ``start`` up to ``stop``."""
    by, sizes, draws, replicates = list(order.by), order.sizes, order.draws, stop - start
    tasks = max(shuffle_width(sizes), min(20_000, math.ceil(order.parts * replicates / 8)))
    begins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(draws).cast("bigint"))).alias("first")
    plan = sizes.select("*", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("replicate")).select("*", begins).select(
        *by, "replicate", "size", "first", F.least(F.col("first") + draws, "size").alias("last"),
        F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*by, "replicate")]).alias("prefix"))
    keys = [*by, "replicate"]
    packets = materialize(
        plan.repartition(tasks).mapInPandas(_draw(keys, order.stretch), f"{_types(plan, keys)}, _stretch bigint, packet binary"), "packets")

    chunk = F.expr(f"replicate div {REPLICATES_TOGETHER}").alias("_chunk")
    chunks = F.explode(F.sequence(
        F.lit(start // REPLICATES_TOGETHER).cast("bigint"), F.lit((stop - 1) // REPLICATES_TOGETHER).cast("bigint"))).alias("_chunk")
    meet = [*by, "_stretch", "_chunk"]
    width = max(shuffle_width(sizes), math.ceil(order.records * replicates / DRAWS_PER_TASK))
    drawn, records = packets.select("*", chunk).repartition(width, *meet), order.stretches.select("*", chunks).repartition(width, *meet)
    whole = ", ".join(f"`{c}` {'double' if c in ('high', 'low') else 'bigint'}" for c in _columns([], len(order.names)) if c != "replicate")
    counts = materialize(
        drawn.groupBy(*meet).cogroup(records.groupBy(*meet)).applyInPandas(
            _count(by, len(order.names), order.stretch, order.step), f"{_types(plan, keys)}, {whole}"), "histogram")
    hist = counts.drop("largest_w")
    return Draws(order.rows, tuple(keys), order.names, totals_of(hist, keys), hist, order.rows_per_task, stored=True, packets=packets,
                 counts=counts, stretch=order.stretch, step=order.step)


def draw_worklist(
    population: DataFrame, scenarios: Mapping[str, Column], replicates: int, seed: int, by: Sequence[str] = ("target",),
    rows_per_task: int = ROWS_PER_TASK, stretch: int = STRETCH, step: int = STEP, draws: int = DRAWS,
) -> Draws:
    """The resamples of ``bootstrap.resample``, draw for draw, as a worklist of (group, replicate).

    One hash per record and replicate is what the law asks for; what is exchanged and written is about a byte per draw,
    and no task holds more than a stretch of ``REPLICATES_TOGETHER`` replicates or ``draws`` draws, whatever the population.
    All draws lie on disk at once; :func:`in_waves` keeps those of a few replicates.
    """
    return _drawn(ranking(population, scenarios, by, rows_per_task, stretch, step, draws), 0, replicates, seed)


def in_waves(
    population: DataFrame, scenarios: Mapping[str, Column], replicates: int, seed: int, ask: Callable[[Draws], DataFrame],
    by: Sequence[str] = ("target",), rows_per_task: int = ROWS_PER_TASK, stretch: int = STRETCH, step: int = STEP, draws: int = DRAWS,
    wave: int | None = None,
) -> DataFrame:
    """``ask`` of the worklists of all replicates, ``wave`` draws (``WAVE`` unless given) at a time.

    The answer of a replicate may depend on nothing but its own draws. Answers are written down, then the draws and their
    shuffle files go, so the disk holds the ranking and one wave, a replicate at least, however many replicates there are.
    """
    order, spark = ranking(population, scenarios, by, rows_per_task, stretch, step, draws), population.sparkSession
    together = max(1, (WAVE if wave is None else wave) // max(1, order.records))
    waves = max(1, math.ceil(replicates / together))
    borders, folder, answers = [replicates * i // waves for i in range(waves + 1)], shared_folder(spark), []
    for start, stop in zip(borders, borders[1:]):
        with run_scope(spark), shuffles_dropped(spark):
            answers.append(materialize(ask(_drawn(order, start, stop, seed)), "answers", folder))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def draw_counts(work: Draws) -> DataFrame:
    """Per group and replicate: draws, distinct records, the largest weight and the events drawn."""
    return work.counts.groupBy(*work.by).agg(
        F.sum("full_n").alias("drawn_n"), F.sum("rows").alias("distinct_n"), F.max("largest_w").alias("largest_w"),
        F.sum("full_e").alias("event_n"))
