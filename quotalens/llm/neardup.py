"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A document's shingles are five consecutive words (lower case); a shorter document has one shingle of all its words. A
shingle weighs its occurrences times its inverse document frequency over all rows of the input. Frequencies are counted
exactly for shingles that stand in more than ``SHARE`` of the documents; the rarer ones all weigh as much as one of that
frequency. So the table of frequencies is bounded, whatever the size of the corpus. Candidates for it are told in a first pass that
loses none of them; their documents are then counted in a second pass.

Consistent weighted samples make two documents agree in a sample with a probability equal to their weighted Jaccard
similarity. Samples are hashed in bands; documents that agree on a band meet in a bucket. Texts with equal words are one
node from the start. In each bucket every node is compared with the centre only, the node whose own buckets are largest,
which is linear in the bucket; links merge nodes into classes; what is then in another class than its bucket's centre
meets the centre of those nodes, and so on for ``ROUNDS`` rounds. Last, all nodes of a bucket that are still in different
classes are compared pair by pair, whatever the size of the bucket; blocks of ``LARGE`` nodes bound the tasks, and every
block meets every other. Every comparison that estimates below the similarity by far (``ESTIMATE``) is skipped; the others
are verified with the exact weighted Jaccard similarity of the two texts.

Null and empty texts have no word and are equal to each other. A class is named by its smallest id (null if it has
none). Rows that repeat an id get one row each. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field, materialize, settled, Shared, slices

by_value(__name__)

SHINGLE, SIMILARITY = 5, 0.8

#: At similarity 0.8 all of 14 bands of 4 samples differ with a probability of 0.0006.
BANDS, ROWS = 14, 4

#: Share of the documents from which a shingle's frequency is counted, and entries of the table of random variables (a power of two).
SHARE, VARIABLES = 0.001, 16

#: Rounds of centres, and nodes of a block in the comparison of what the centres left.
ROUNDS, LARGE = 2, 256

#: Share of equal samples below which similarity 0.8 is out of reach (five standard deviations).
ESTIMATE = 0.53

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_NAME, _LOWER = np.uint32(2246822519), int(sys.byteorder == "big")
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x5F or b >= 0x80 else 0x20 for b in range(256))
_STEP = np.array([pow(_BASE, 2 * k + 3, 1 << 64) for k in range(max(SHINGLE, BANDS * ROWS, 8))], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, as far as the longest text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))


def hashed_words(texts: list[str | None], powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, from prefix sums of a polynomial over the bytes, and each text's first word (and the end).

    A word's hash does not depend on its place, so texts in a row hash as each alone.
    """
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_WORD), np.uint8)
    inside = np.concatenate([[False], data != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    powers.reach(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:len(data)], dtype=np.uint64)])
    words = mix((total[last] - total[first]) * powers.down[first] + (last - first).astype(np.uint64))
    return words, np.searchsorted(first, np.cumsum([0] + [len(x) + 1 for x in raw]))


def word_hashes(text: str | None, powers: _Powers) -> np.ndarray:
    return hashed_words([text], powers)[0]


#: Bytes of text that are hashed in one go; a longer text goes alone.
_GROUP = 1 << 16


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= _GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _within(starts: np.ndarray) -> np.ndarray:
    """The place of every item within its document, from 0."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def nodes_of(words: np.ndarray, starts: np.ndarray) -> list[str]:
    """128 bits of each document's word sequence."""
    n = np.diff(starts)
    some = starts[:-1][n > 0]
    one, two = np.zeros((2, len(n)), np.uint64)
    if len(some):
        order = mix((_within(starts) + 1).astype(np.uint64) * np.uint64(_BASE))
        one[n > 0] = np.bitwise_xor.reduceat(mix(words ^ order), some) ^ n[n > 0].astype(np.uint64)
        two[n > 0] = np.add.reduceat(mix(words + order * _M1), some)
    return [f"{a:016x}{b:016x}" for a, b in zip(one.tolist(), two.tolist())]


class Rarity:
    """Inverse document frequencies: of the frequent shingles one by one, of all others together."""

    def __init__(self, rows: int, shingles: np.ndarray, held: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.idf = shingles[order], np.log((rows + 1) / (held[order] + 1)) + 0.05
        self.other = float(np.log((rows + 1) / (max(1.0, rows * SHARE) + 1)) + 0.05)

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), self.other)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
            known = self.shingles[at] == s
            out[known] = self.idf[at[known]]
        return out


def grouped_shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct shingles, ascending, their occurrences, and each document's first shingle (and the end)."""
    n = np.diff(starts)
    s = words * _STEP[0]
    for k in range(1, SHINGLE):
        s[:max(0, len(s) - k)] += words[k:] * _STEP[k]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):  # one shingle of all its words
        s[starts[d]] = (words[starts[d]:starts[d + 1]] * _STEP[:n[d]]).sum(dtype=np.uint64)
    held = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    s = mix(s[_within(starts) < np.repeat(held, n)])
    bounds = np.concatenate([[0], np.cumsum(held)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[bounds[:-1][held > 0]] = True
    at = np.flatnonzero(new)
    return s[at], np.diff(at, append=len(s)), np.searchsorted(at, bounds)


def counted_shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their occurrences."""
    return grouped_shingles(words, np.array([0, len(words)]))[:2]


def weighted_shingles(words: np.ndarray, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    s, times = counted_shingles(words)
    return s, rarity.of(s) * times


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard; two documents without words are equal."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    common = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def variables() -> tuple[np.ndarray, ...]:
    """The random variables of the sampling, drawn once: r, 1 / r, beta, and ln c + r beta - r, all of one table entry."""
    rng = np.random.default_rng(2010)
    size = 1 << VARIABLES
    r, ln_c, beta = rng.gamma(2, 1, size) + 1e-4, np.log(rng.gamma(2, 1, size)), rng.random(size)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, beta, ln_c + r * beta - r))


def samples(s: np.ndarray, w: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, ...]) -> np.ndarray:
    """One 32-bit sample for each place of each band and each document; ``starts`` are the documents' first shingles.

    A sample is the shingle with the smallest a = c exp(-r t) and its t = floor(ln w / r + beta). Order and identity share
    one 64-bit number: the upper half orders by ln a, the lower half tells shingle and t and breaks ties. Most shingles have
    one weight, that of a rare one that occurs once: for it, that number but for the shingle's part is drawn up per table entry.
    """
    r, inverse, beta, rest = table
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32) * _NAME

    def drawn(ln_w, at) -> np.ndarray:
        t = np.floor(ln_w * inverse[at] + beta[at])
        ln_a = rest[at] - r[at] * t
        ln_a += np.float32(256)  # above zero, floats order as their bits do
        name = t.astype(np.int32).view(np.uint32) * np.uint32(2654435761) * _NAME
        return (ln_a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | name

    usual = np.partition(w, len(w) // 2)[len(w) // 2]
    ready = drawn(np.log(np.array([usual])).astype(np.float32), slice(None))
    odd = np.flatnonzero(w != usual)
    ln_w = np.log(w[odd]).astype(np.float32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    key = np.empty(len(s), np.uint64)
    half = key.view(np.uint32)[_LOWER::2]
    for k in range(BANDS * ROWS):
        at = (low * np.uint32(_STEP[k] >> np.uint64(32) | np.uint64(1)) + np.uint32(_STEP[k] & np.uint64(0xFFFFFFFF))) >> np.uint32(32 - VARIABLES)
        ready.take(at, out=key, mode="clip")
        key[odd] = drawn(ln_w, at[odd])
        half += high
        out[:, k] = np.minimum.reduceat(key, starts).astype(np.uint32)
    return out


def band_keys(chosen: np.ndarray) -> np.ndarray:
    """The keys of each row of samples."""
    x = np.zeros((len(chosen), BANDS), np.uint64)
    for k in range(ROWS):
        x = mix(x + chosen.reshape(-1, BANDS, ROWS)[:, :, k].astype(np.uint64) * _STEP[k] + np.uint64(k + 1))
    return mix(x + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).astype(np.int64)


#: Shingles that a task adds to its counters in one go, and counters that travel together.
_CHUNK, _PIECE = 1 << 20, 1 << 15


def _cells(s: np.ndarray, size: int) -> np.ndarray:
    """The places of each shingle in two rows of ``size`` counters, from independent bits of its hash."""
    last = np.uint64(size - 1)
    return np.stack([s & last, (s >> np.uint64(32)) & last]).astype(np.int64)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The distinct shingles of each document, put together to about ``_CHUNK`` of them."""
    powers, waiting, size = _Powers(), [], 0
    for batch in batches:
        for piece in slices(batch, 8 << 20):
            for together in groups(piece.column(0).to_pylist()):
                waiting.append(grouped_shingles(*hashed_words(together, powers))[0])
                size += len(waiting[-1])
                if size >= _CHUNK:
                    yield np.concatenate(waiting)
                    waiting, size = [], 0
    if size:
        yield np.concatenate(waiting)


def counters(rows: int, characters: int) -> int:
    """Counters of a row: some four for each document that SHARE stands for, times the shingles of an average text. A power of two.

    So a counter's share of the other shingles stays well below the frequency looked for, whatever the number of documents.
    """
    each = characters / max(1, rows) / 5 + 1
    return 1 << int(np.clip(np.ceil(np.log2(4 * each / SHARE)), 16, 30))


def shingle_rarity(df: DataFrame, text: str = "text") -> Rarity:
    """Frequencies over all rows, however they are partitioned. At most 1 / SHARE times the shingles of an average document reach the driver.

    A first pass adds every document's shingles into two rows of counters, whose size depends on the average text and not on
    the corpus. Counters only add up, over documents and over tasks, so none is below the frequency of any shingle in it: what
    is frequent has two high counters. The shingles with two high counters, few others among them, are counted exactly in a
    second pass.
    """
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0)).alias("n")).first()
    rows, size = total["rows"], counters(total["rows"], total["n"])
    least, width = max(2.0, rows * SHARE), min(size, _PIECE)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pack = np.zeros((2, size), np.uint32), pa.Codec("zstd")
        for s in _shingles(batches):
            for row, cells in zip(n, _cells(s, size)):
                row += np.bincount(cells, minlength=size).astype(np.uint32)
        for place, part in enumerate(n.reshape(-1, width)):
            if part.any():
                raw = pack.compress(part.tobytes(), asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([raw], pa.binary())], names=["place", "n"])

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, last, n = pa.Codec("zstd"), None, np.zeros(width, np.int64)

        def found():
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([np.packbits(n >= least).tobytes()], pa.binary())], names=["place", "high"])

        for batch in batches:
            for place, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and place != last:
                    yield found()
                    n = np.zeros(width, np.int64)
                last = place
                n += np.frombuffer(pack.decompress(raw, 4 * width, asbytes=True), np.uint32)
        if last is not None:
            yield found()

    # A task's counters are as large for few documents as for many, so small partitions are read together.
    together = df.select(text).coalesce(max(1, int(rows * SHARE)))
    pieces = together.mapInArrow(settled(sketch), "place long, n binary").repartition("place").sortWithinPartitions("place")
    bits = np.zeros((2 * size // width, width // 8), np.uint8)
    for r in pieces.mapInArrow(settled(high), "place long, high binary").collect():  # one bit for each counter
        bits[r["place"]] = np.frombuffer(r["high"], np.uint8)
    shared = Shared(df, bits.reshape(2, -1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for s in _shingles(batches):
            one, two = (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 for row, c in zip(marks, _cells(s, size)))
            s = s[(one & two) > 0]
            new, times = np.unique(s, return_counts=True)
            names, place = np.unique(np.concatenate([names, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(names)).astype(np.int64)
        for at in range(0, len(names), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(names[part].view(np.int64)), pa.array(counts[part])], names=["shingle", "n"])

    counted = together.mapInArrow(settled(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    held = counted.filter(F.col("n") >= least).toPandas()
    return Rarity(rows, held["shingle"].to_numpy(np.int64).view(np.uint64), held["n"].to_numpy(float))


def _connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, class) of the nodes on edges (a, b): smallest node of the component, by repeated joins."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), name)
    while True:
        heard = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(heard, "node").select("node", F.col("class").alias("old"), F.least("class", "other").alias("next"))
        jump = step.join(labels.toDF("next", "further"), "next").withColumn("class", F.least("next", "further"))
        moved = materialize(jump.select("node", "class", (F.col("class") != F.col("old")).alias("moved")), name)
        labels = moved.select("node", "class")
        if moved.filter("moved").isEmpty():
            return labels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, low, high), the first three columns; they come in this order."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        edge = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(0)) + 1
        for a, b in zip([0, *edge], [*edge, batch.num_rows]):
            now = tuple(mark[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, width)


def _candidates(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the block's two sides: of different classes, in the first band they share, with enough equal samples."""
    key, low, high = (rows.column(k)[0].as_py() for k in range(3))
    side = rows.column("side").to_numpy()
    one, two = np.flatnonzero(side == low), np.flatnonzero(side == high)
    kind = np.unique(rows.column("class").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    keys, chosen = _matrix(rows.column("keys"), BANDS), _matrix(rows.column("samples"), BANDS * ROWS)
    earlier = keys[:, :int(np.flatnonzero((keys == key).all(0))[0])]
    out = []
    strip = max(1, (1 << 20) // (BANDS * ROWS * max(1, len(two))))
    for at in range(0, len(one), strip):
        x = one[at:at + strip]
        fits = kind[x][:, None] != kind[two][None]
        if low == high:
            fits &= x[:, None] < two[None]
        if fits.any():
            fits &= (chosen[x][:, None] == chosen[two][None]).sum(2) >= ESTIMATE * BANDS * ROWS
            fits &= ~(earlier[x][:, None] == earlier[two][None]).any(2)
        i, j = np.nonzero(fits)
        out.append((x[i], two[j]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (one[:0], two[:0])


#: Shingles (by occurrence) that are multiplied in one go.
_COLUMNS = 1024


def _similarities(i: np.ndarray, j: np.ndarray, held: dict[int, tuple[np.ndarray, np.ndarray]], rarity: Rarity) -> np.ndarray:
    """Weighted Jaccard of many pairs of the same documents, from products of their shingle matrices. ``held``: shingles, occurrences."""
    who = np.array(sorted(held))
    parts = [held[k] for k in who]
    column = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
    times = np.concatenate([t for _, t in parts])
    owner = np.repeat(np.arange(len(who)), [len(s) for s, _ in parts])
    total = np.bincount(owner, rarity.of(column[0])[column[1]] * times, len(who))
    # A shingle's first, second, ... occurrence are columns of their own: common ones are the smaller number of occurrences.
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    tag = np.repeat(column[1], times) * (int(times.max(initial=0)) + 1) + nth
    names, place, often = np.unique(tag, return_inverse=True, return_counts=True)
    kept = often > 1  # what one document holds alone is common to none
    new = np.cumsum(kept) - 1
    weight = rarity.of(column[0])[names[kept] // (int(times.max(initial=0)) + 1)]
    row, place = np.repeat(owner, times)[kept[place]], new[place[kept[place]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(who), len(who)))
    for at in range(0, len(weight), _COLUMNS):
        a, b = np.searchsorted(place, (at, at + _COLUMNS))
        x = np.zeros((len(who), min(_COLUMNS, len(weight) - at)))
        x[row[a:b], place[a:b] - at] = 1
        common += (x * weight[at:at + _COLUMNS]) @ x.T
    i, j = np.searchsorted(who, i), np.searchsorted(who, j)
    whole = total[i] + total[j] - common[i, j]
    return np.where(whole > 0, common[i, j] / np.where(whole > 0, whole, 1), 1.0)


def _rest_links(named: DataFrame, several: DataFrame, first: Column, nodes: DataFrame, texts: DataFrame, rarity: Rarity) -> DataFrame:
    """Links (a, b, similarity) between classes that share a bucket; as many of each block as join its classes.

    ``named``: key, node, drawn, class. A pair of different classes has a node outside the class of its bucket's centre. So
    these nodes, in blocks of ``LARGE``, meet each other's blocks and those of the centre's class: every pair meets once,
    and a block's task holds twice ``LARGE`` nodes at most.
    """
    named = named.join(several, "key")
    centre = named.groupBy("key").agg(first)
    named = named.join(centre, "key").select("key", "node", "class", (F.col("class") != F.col("c.class")).alias("outside"))
    named = materialize(named, "rest")
    parts = named.groupBy("key").agg(
        F.ceil(F.count_if("outside") / LARGE).cast("int").alias("few"), F.ceil(F.count_if(~F.col("outside")) / LARGE).cast("int").alias("many"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("few")).otherwise(F.col("many"))).cast("int")
    dealt = named.join(parts, "key").withColumn("side", own + F.when(F.col("outside"), 0).otherwise(F.col("few")))
    meets = F.sequence(F.lit(0), F.when(F.col("outside"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    dealt = dealt.withColumn("other", F.explode(meets)).select(
        "key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "class")
    dealt = dealt.join(nodes, "node").select("key", "low", "high", "side", "node", "class", "keys", "samples")
    schema = "key long, low int, high int, side int, node string, class string, keys array<long>, samples array<int>"

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            chosen = np.unique(np.concatenate(_candidates(rows)))
            if len(chosen):
                yield from rows.take(chosen).combine_chunks().to_batches()

    found = materialize(met(dealt).mapInArrow(settled(near), schema), "rest-near")
    shared = Shared(named, rarity)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for rows in _blocks(batches):
            i, j = _candidates(rows)
            if not len(i):
                continue
            packed, node, kind = (rows.column(c) for c in ("packed", "node", "class"))
            held = {int(k): counted_shingles(word_hashes(unpack(packed[int(k)].as_py()), powers)) for k in np.unique(np.concatenate([i, j]))}
            same = _similarities(i, j, held, shared.value)
            name = {}

            def root(k):
                while name.get(k, k) != k:
                    k = name[k]
                return k

            links = []
            for at in np.flatnonzero(same >= SIMILARITY - 1e-9):
                a, b = int(i[at]), int(j[at])
                one, two = root(kind[a].as_py()), root(kind[b].as_py())
                if one == two:
                    continue
                if abs(same[at] - SIMILARITY) < 1e-9:  # sums in another order
                    same[at] = similarity(*[(held[k][0], shared.value.of(held[k][0]) * held[k][1]) for k in (a, b)])
                if same[at] >= SIMILARITY:
                    name[max(one, two)] = min(one, two)
                    links.append((node[a].as_py(), node[b].as_py(), float(same[at])))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*links), (pa.string(), pa.string(), pa.float64()))], names=["a", "b", "similarity"])

    whole = found.join(texts.select("node", "packed"), "node").select(*found.columns, "packed")
    return materialize(met(whole).mapInArrow(settled(join), "a string, b string, similarity double"), "links-rest")


class _Verifier:
    """Compares pairs of nodes by their texts. Texts travel compressed."""

    def __init__(self, texts: DataFrame, rarity: Rarity):
        self.texts, self.rarity = texts, rarity

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of ``pairs`` (a, b), nodes, that are similar enough."""
        pairs = materialize(pairs.select("a", "b").distinct(), f"{name}-pairs")
        left = self.texts.select(F.col("node").alias("a"), F.col("packed").alias("left"))
        right = self.texts.select(F.col("node").alias("b"), F.col("packed").alias("right"))
        shared = Shared(pairs, self.rarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers, last = _Powers(), {}

            def parsed(node, packed):
                if node not in last:
                    if len(last) > 64:
                        last.clear()
                    last[node] = weighted_shingles(word_hashes(unpack(packed), powers), shared.value)
                return last[node]

            for batch in batches:
                a, left_texts, b, right_texts = (c.to_pylist() for c in batch.columns)
                same = [similarity(parsed(x, s), parsed(y, t)) for x, s, y, t in zip(a, left_texts, b, right_texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same, pa.float64())], names=["a", "b", "similarity"])

        met = pairs.join(left, "a").join(right, "b").select("a", "left", "b", "right")
        return materialize(met.mapInArrow(settled(run), "a string, b string, similarity double").filter(F.col("similarity") >= SIMILARITY), name)


def pack(text: str | None) -> bytes:
    raw = (text or "").encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> str:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True).decode() if size else ""


def _agreement(one: Column, two: Column) -> Column:
    """Share of equal samples."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / (BANDS * ROWS)


#: Shingles that are sampled in one go.
_TOGETHER = 1 << 16


def signatures(df: DataFrame, rarity: Rarity, text: str, keep: list[str]) -> DataFrame:
    """``keep``, node, band keys and samples of every row. Rows of one node in one slice of a batch are sampled once."""
    shared = Shared(df, rarity)

    def start():
        powers, table = _Powers(), variables()

        def work(texts):
            nodes, place, waiting, chosen, size = [], {}, [], [np.zeros((1, BANDS * ROWS), np.uint32)], 0
            place["0" * 32] = 0  # a text without words

            def flush():
                if waiting:
                    shingles, times, n = (np.concatenate(x) for x in zip(*waiting))
                    starts = np.cumsum(n) - n
                    chosen.append(samples(shingles, shared.value.of(shingles) * times, starts, table))
                    waiting.clear()

            for together in groups(texts):
                words, starts = hashed_words(together, powers)
                found = nodes_of(words, starts)
                nodes += found
                new = np.zeros(len(found), bool)
                for at, node in enumerate(found):
                    if node not in place:
                        place[node] = len(place)
                        new[at] = True
                if not new.any():
                    continue
                n = np.diff(starts)
                words, starts = words[np.repeat(new, n)], np.concatenate([[0], np.cumsum(n[new])])
                shingles, times, starts = grouped_shingles(words, starts)
                waiting.append((shingles, times, np.diff(starts)))
                size += len(shingles)
                if size >= _TOGETHER:
                    flush()
                    size = 0
            flush()
            rows = np.concatenate(chosen)
            keys, at = band_keys(rows), [place[node] for node in nodes]
            return [nodes, list(keys[at]), list(rows[at].view(np.int32))]

        return work

    fields = [field("node", "string"), field("keys", "array<long>"), field("samples", "array<int>")]
    return append_columns(df, text, fields, start, keep)


def node_classes(rows: DataFrame, docs: DataFrame, rarity: Rarity) -> DataFrame:
    """(node, class) of all nodes. ``rows``: node, keys, samples, mark; ``docs``: mark, text, where mark tells texts apart."""
    nodes = materialize(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("keys", "samples", "mark")]), "nodes")

    # Buckets of two nodes or more: (key, node, n), n nodes in the bucket.
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = keyed.join(crowded, "key")
    # The centre of a bucket is the node whose buckets are largest: in a group of copies, the text they derive from.
    drawn = members.groupBy("node").agg(F.sum("n").alias("drawn"))
    members = materialize(members.join(drawn, "node"), "members")
    active = members.select("node").distinct().join(nodes.select("node", "mark"), "node")
    packed = append_columns(docs, "text", [field("packed", "binary")], lambda: lambda texts: [[pack(t) for t in texts]], ["mark"])
    texts = packed.join(active, "mark").groupBy("node").agg(F.first("packed").alias("packed"))
    texts = materialize(texts, "texts")
    verifier = _Verifier(texts, rarity)
    sketch = nodes.select("node", "samples")

    def close(pairs: DataFrame) -> DataFrame:
        near = pairs.select("a", "b").distinct().join(sketch.toDF("a", "one"), "a").join(sketch.toDF("b", "two"), "b")
        return near.filter(_agreement(F.col("one"), F.col("two")) >= ESTIMATE)

    links, labels = None, members.select("node").distinct().withColumn("class", F.col("node"))
    left = members.select("key", "node", "drawn", F.col("node").alias("class"))
    first = F.min(F.struct((-F.col("drawn")).alias("order"), "node", "class")).alias("c")
    for turn in range(ROUNDS):
        centre = left.groupBy("key").agg(first)
        star = left.join(centre, "key").filter(F.col("node") != F.col("c.node")).filter(F.col("class") != F.col("c.class"))
        found = verifier.links(close(star.select(F.col("node").alias("a"), F.col("c.node").alias("b"))), f"links{turn}")
        links = found if links is None else links.union(found)
        labels = _connected(links, f"classes{turn}")
        named = members.select("key", "node", "drawn").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
        centre = named.groupBy("key").agg(first)
        left = materialize(named.join(centre, "key").filter(F.col("class") != F.col("c.class")).select("key", "node", "drawn", "class"), f"left{turn}")

    # What is in several classes still: all pairs of different classes in one bucket, block by block.
    links = links.union(_rest_links(members.select("key", "node", "drawn").join(labels, "node", "left").withColumn(
        "class", F.coalesce("class", "node")), left.select("key").distinct(), first, nodes.select("node", "keys", "samples"), texts, rarity))
    labels = _connected(links, "classes")
    return materialize(nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("class", "node").alias("class")), "all-classes")


def _marked(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("__mark", F.struct(F.xxhash64(body).alias("hash"), F.length(body).alias("size"))).withColumn("__text", body)


def _classified(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, class) of every node."""
    docs = _marked(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select(
        "doc_id", F.col("__mark").alias("mark"), F.col("__text").alias("text"))
    rarity = shingle_rarity(docs)
    rows = materialize(signatures(docs, rarity, "text", ["doc_id", "mark"]), "signatures")
    return rows.select("doc_id", "mark", "node"), node_classes(rows, docs.select("mark", "text"), rarity)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_rows): the class of every row, named by its smallest id, and the rows of that class."""
    rows, classes = _classified(df, doc_id, text)
    placed = rows.select("doc_id", "node").join(classes, "node")
    names = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
    return placed.join(names, "class").select("doc_id", "class_id", "n_rows")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class: the one with the smallest id (a row without id only if the class has none)."""
    order = df.columns
    rows, classes = _classified(df, doc_id, text)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "mark")).alias("kept")
    kept = rows.join(classes, "node").groupBy("class").agg(least).select(F.col("kept.doc_id").alias("__id"), F.col("kept.mark").alias("__mark"))
    held = _marked(df, text).join(kept, "__mark").filter(F.col(doc_id).eqNullSafe(F.col("__id")))
    return held.dropDuplicates(["__mark"]).select(*order)
