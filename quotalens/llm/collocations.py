"""Phrase collocations: frequent phrases of two to five words, scored by the weakest of their cuts.

Counting takes two kinds of passes. The first finds candidates: every task counts hashes of its phrases, deals them to hash
partitions, and a partition merges what it gets into one Misra-Gries summary. Its capacity is more than twice the
partition's mass (all counts dealt to it) divided by the threshold, so that all decrements together stay below half of the
threshold; a phrase stays a candidate if its counter and the decrements reach the threshold, which no frequent phrase can
miss. Memory is bounded by the capacity, whatever the number of different phrases; a partition learns its mass first, as
masses are sorted before counts. Words and pairs come first; longer phrases are counted only where all their pairs are
candidates, since no phrase is more frequent than its parts. Candidates travel as a filter of ``FILTER_BITS`` bits: the
size is fixed, and a chance hit only costs a count. The second pass counts what passes the filter exactly, by its words.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. A
phrase never crosses pieces. Very long texts are read in parts that share their last words, so memory doesn't grow with
them. Null texts are empty; a null language counts as ``und``. Rows that repeat an id or a text all count; ids and other
columns play no part. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotalens.llm.common import Shared, by_value, materialize
from quotalens.llm.substrings import Hashes, mix, pack, unpack, unzip, zipped

by_value(__name__)

#: Words of a phrase, occurrences it needs, rows reported for a language, and the share of a phrase's occurrences (percent)
#: from which a longer phrase around it stands for it.
LONGEST, THRESHOLD, REPORTED, ABSORBED = 5, 100, 2000, 100

#: Bits of the filter, hashes in it for one candidate, and phrases whose hashes a task sorts together.
FILTER_BITS, PROBES, TOGETHER = 1 << 27, 3, 1 << 22

#: Phrases (all occurrences) of a hash partition on average, and the largest number of hash partitions.
BUCKET_MASS, MOST_BUCKETS = 1 << 22, 1 << 16

#: Bytes of text that are split into words together.
BLOCK = 1 << 21

_WORD, _GAP, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _END
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = mix(np.arange(1, 2 * LONGEST + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# --- Words and phrases of texts ------------------------------------------------------------------------------------

class Words(NamedTuple):
    """Words of some texts: their bytes, places, pieces and languages. The first ``known`` words were counted before."""

    data: bytes
    start: np.ndarray
    stop: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]
    known: int


def _words(parts: list[tuple[str, bytes]], known: int = 0) -> Words:
    data = b"\n".join(p for _, p in parts)
    kind = _KIND[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], kind == _WORD, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    ends = np.flatnonzero(kind == _END)
    size = np.array([len(p) for _, p in parts], np.int64) + 1
    langs = sorted({lang for lang, _ in parts})
    number = np.array([langs.index(lang) for lang, _ in parts])
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    return Words(data, start, stop, np.searchsorted(ends, start), number[owner], langs, known)


def _long(lang: str, data: bytes) -> Iterator[Words]:
    """A long text in parts cut at separators; a part begins with the last words of the one before, if their piece goes on."""
    at, tail, known = 0, b"", 0
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data):
            gaps = np.flatnonzero(_KIND[np.frombuffer(data[at:stop], np.uint8)] != _WORD)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(len(data), stop + BLOCK)  # one word longer than a block
        part = tail + data[at:stop]
        words = _words([(lang, part)], known)
        yield words
        open_ = words.piece == np.count_nonzero(_KIND[np.frombuffer(part, np.uint8)] == _END)
        last = np.flatnonzero(open_)[-(LONGEST - 1):]
        tail = b"".join(part[words.start[k]:words.stop[k]] + b" " for k in last)
        at, known = stop, len(last)


def split(rows: Iterable[tuple[str | None, str | None]]) -> Iterator[Words]:
    """Words of (language, text) rows, block by block."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for lang, text in rows:
        lang, data = "und" if lang is None else lang, (text or "").encode().translate(_LOWER)
        if len(data) > BLOCK:
            yield from _long(lang, data)
            continue
        held.append((lang, data))
        size += len(data) + 1
        if size >= BLOCK:
            yield _words(held)
            held, size = [], 0
    if held:
        yield _words(held)


def word_hashes(words: Words, turn: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; another ``turn`` gives an independent one."""
    data = np.frombuffer(words.data, np.uint8)
    if turn:
        data = mix(data.astype(np.uint64) + _STEP[turn])
    sums = Hashes(data)
    size = words.stop - words.start
    return mix(sums.of(words.start, size) * _STEP[turn] + size.astype(np.uint64))


def phrase_hashes(words: Words, hashes: np.ndarray, n: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First words of the phrases of ``n`` words that were not counted before, and their hashes, which tell languages apart."""
    first = np.arange(max(0, words.known - n + 1), len(hashes) - n + 1)
    first = first[words.piece[first] == words.piece[first + n - 1]]
    seed = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8, key=bytes([turn])).digest(), "little") for x in words.langs], np.uint64)
    total = seed[words.lang[first]] + np.uint64(n)
    for k in range(n):
        total = total + hashes[first + k] * _STEP[k + 1]
    return first, mix(total)


# --- The filter ----------------------------------------------------------------------------------------------------

def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in the filter, one row a probe."""
    again = mix(hashes + _STEP[0])
    return np.stack([(hashes + np.uint64(k) * (again | np.uint64(1))) & np.uint64(bits - 1) for k in range(PROBES)])


def passes(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set."""
    out = np.ones(len(hashes), bool)
    for place in _bits(hashes, 64 * len(held)):
        out &= (held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _allowed(words: Words, hashes: np.ndarray, n: int, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``n`` words, of more than two only where all their pairs pass the filter."""
    first, own = phrase_hashes(words, hashes, n)
    if held is None or n <= 2:
        return first, own
    start, pair = phrase_hashes(words._replace(known=0), hashes, 2)
    good = np.zeros(len(hashes) + n, np.int64)
    good[start[passes(pair, held)]] = 1
    reach = np.concatenate([[0], np.cumsum(good)])
    whole = reach[first + n - 1] - reach[first] == n - 1
    return first[whole], own[whole]


# --- First passes: mergeable summaries ------------------------------------------------------------------------------

def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of numbers, all first bytes before all second ones: these compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).reshape(-1)


def _numbers(planes: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def _deal(lengths: tuple[int, ...], buckets: int, shared: Shared | None):
    """Rows of (bucket, kind, mass, counts): kind 0 has a mass alone, kind 1 hashes and their counts in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows = []
            for a, b in zip(edge[:-1], edge[1:]):
                if a < b:
                    mass, number = int(n[a:b].sum()), int(bucket[a])
                    step = np.diff(hashes[a:b], prepend=np.uint64(0))
                    rows += [(number, 0, mass, None), (number, 1, 0, pack(_planes(step), _planes(n[a:b].astype("<u4"))))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["bucket", "kind", "mass", "counts"])

        for words in split(_pairs(batches)):
            hashes = word_hashes(words)
            for n in lengths:
                held.append(_allowed(words, hashes, n, shared.value if shared else None)[1])
                size += len(held[-1])
            if size >= TOGETHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield from zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters after a merge; ``lost`` is the most that any count is too low."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, place = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(self.hashes)).astype(np.int64)
        if len(self.counts) > self.capacity:  # every counter falls by the largest one that is too many
            at = len(self.counts) - self.capacity - 1
            fall = int(np.partition(self.counts, at)[at])
            self.lost += fall
            kept = self.counts > fall
            self.hashes, self.counts = self.hashes[kept], self.counts[kept] - fall

    def candidates(self, threshold: int) -> np.ndarray:
        return self.hashes[self.counts + self.lost >= threshold]


def capacity_of(mass: int, threshold: int) -> int:
    """Enough counters to keep all decrements of a summary below half of the threshold."""
    return 2 * mass // threshold + 1


def _summarize(threshold: int, bits: int):
    """Filter words (place, bits) of the candidates. Rows come by bucket, masses before counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, mass, summary, waiting, size = None, 0, None, [], 0

        def absorb():
            nonlocal waiting, size
            if waiting:
                summary.merge(*(np.concatenate(x) for x in zip(*waiting)))
                waiting, size = [], 0

        def done():
            found = _bits(summary.candidates(threshold), bits).reshape(-1) if summary else np.zeros(0, np.uint64)
            place, back = np.unique(found >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(place), np.uint64)
            np.bitwise_or.at(value, back, np.uint64(1) << (found & np.uint64(63)))
            return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(value.view(np.int64))], names=["place", "bits"])

        for batch in batches:
            for row in range(batch.num_rows):
                number, kind = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if number != bucket:
                    absorb()
                    if summary:
                        yield done()
                    bucket, mass, summary = number, 0, None
                if kind == 0:
                    mass += batch.column(2)[row].as_py()
                    continue
                summary = summary or Summary(capacity_of(mass, threshold))
                steps, counts = unpack(batch.column(3)[row].as_py(), "u1", "u1")
                waiting.append((np.cumsum(_numbers(steps, "<u8"), dtype=np.uint64), _numbers(counts, "<u4").astype(np.int64)))
                size += len(waiting[-1][0])
                if size >= max(TOGETHER // 4, 4 * summary.capacity):
                    absorb()
        absorb()
        if summary:
            yield done()

    return run


def _buckets(size: int, lengths: int) -> int:
    """Hash partitions for the phrases of so many lengths in ``size`` bytes, at about six bytes a word."""
    return int(min(MOST_BUCKETS, max(8, -(-size * lengths // (6 * BUCKET_MASS)))))


def candidate_filter(rows: DataFrame, lengths: tuple[int, ...], size: int, before: np.ndarray | None, threshold: int, bits: int) -> np.ndarray:
    """The filter of all phrases of these lengths that may reach the threshold, and of what ``before`` holds.

    ``rows``: language and text, ``size`` bytes of text in all. The filter reaches the driver as at most ``bits`` / 64 rows.
    """
    buckets = _buckets(size, len(lengths))
    dealt = rows.mapInArrow(_deal(lengths, buckets, None if before is None else Shared(rows, before)), "bucket long, kind int, mass long, counts binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    words = dealt.mapInArrow(_summarize(threshold, bits), "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    held = np.zeros(bits // 64, np.uint64) if before is None else before.copy()
    found = words.toPandas()
    held[found["place"].to_numpy(np.int64)] |= found["bits"].to_numpy(np.int64).view(np.uint64)
    return held


# --- Second pass: exact counts ------------------------------------------------------------------------------------

#: Phrases a task holds with their counts before it hands them on.
_HELD = 1 << 19


def _count(buckets: int, shared: Shared):
    """Rows of (bucket, lang, counts, phrases): what the task counted, dealt by a hash. An empty phrase stands for all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[int, int], list] = {}
        totals: dict[str, int] = {}

        def flush():
            dealt: dict[tuple[int, str], tuple[list, list]] = {}
            for (one, _), (lang, phrase, n) in table.items():
                counts, phrases = dealt.setdefault(((one >> 40) * buckets >> 24, lang), ([], []))
                counts.append(n)
                phrases.append(phrase)
            for lang, n in totals.items():
                counts, phrases = dealt.setdefault((0, lang), ([], []))
                counts.append(n)
                phrases.append(b"")
            rows = [(bucket, lang, pack(_planes(np.array(counts, "<u8"))), zipped(b"\n".join(phrases))) for (bucket, lang), (counts, phrases) in dealt.items()]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            table.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["bucket", "lang", "counts", "phrases"])

        for words in split(_pairs(batches)):
            if not len(words.start):
                continue
            own, again = word_hashes(words), word_hashes(words, 1)
            for lang, n in zip(words.langs, np.bincount(words.lang[words.known:], minlength=len(words.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            for n in range(1, LONGEST + 1):
                first, one = _allowed(words, own, n, shared.value)
                good = passes(one, shared.value)
                first, one = first[good], one[good]
                two = _second(words, again, n, first)
                order = np.lexsort((two, one))
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)])[:len(order)])
                often = np.diff(np.append(edge, len(order)))
                for a, b, k, times in zip(one[order[edge]].tolist(), two[order[edge]].tolist(), first[order[edge]].tolist(), often.tolist()):
                    row = table.get((a, b))
                    if row is None:
                        phrase = b" ".join(words.data[x:y] for x, y in zip(words.start[k:k + n].tolist(), words.stop[k:k + n].tolist()))
                        table[a, b] = [words.langs[words.lang[k]], phrase, times]
                    else:
                        row[2] += times
            if len(table) >= _HELD:
                yield flush()
        if table or totals:
            yield flush()

    return run


def _sum(threshold: int):
    """Rows of (lang, words, phrase, n) that reach the threshold, or hold all words of a language (zero words). Rows come by bucket and language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, table = None, {}

        def done():
            rows = [(group[1], phrase.count(b" ") + 1 if phrase else 0, phrase, n) for phrase, n in table.items() if n >= threshold or not phrase]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["lang", "words", "phrase", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                bucket, lang, counts, phrases = (batch.column(k)[row].as_py() for k in range(4))
                if group != (bucket, lang):
                    if table:
                        yield done()
                    group, table = (bucket, lang), {}
                (planes,) = unpack(counts, "u1")
                for phrase, n in zip(unzip(phrases).split(b"\n"), _numbers(planes, "<u8").tolist()):
                    table[phrase] = table.get(phrase, 0) + n
        if table:
            yield done()

    return run


def _second(words: Words, hashes: np.ndarray, n: int, first: np.ndarray) -> np.ndarray:
    start, two = phrase_hashes(words, hashes, n, 1)
    return two[np.searchsorted(start, first)]


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, words, phrase, n): every word and phrase that stands at least ``threshold`` times; zero words: all words of the language."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    held = candidate_filter(rows, (1, 2), size, None, threshold, bits)
    held = candidate_filter(rows, tuple(range(3, LONGEST + 1)), size, held, threshold, bits)
    buckets = _buckets(size, LONGEST)
    dealt = rows.mapInArrow(_count(buckets, Shared(rows, held)), "bucket long, lang string, counts binary, phrases binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(_sum(threshold), "lang string, words int, phrase string, n long")


#: Parts of a language that are ranked before they are ranked together.
_PARTS = 16


# --- Scores ---------------------------------------------------------------------------------------------------------

def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, reported: int = REPORTED, absorbed: int = ABSORBED,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``reported`` best phrases.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words. A phrase inside a longer one that
    has ``absorbed`` percent of its occurrences or more is left out.
    """
    counts = materialize(phrase_counts(df, text, lang, threshold, bits), "phrases")
    totals = materialize(counts.filter("words = 0").select("lang", F.col("n")), "words")
    phrases = counts.filter("words > 0")
    parts = F.split("phrase", " ")
    several = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    known = phrases.select("lang", "phrase", "n")
    cut = cut.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("1000BD * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    longer = several.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1))).select(
        "lang", F.array_join(F.slice(parts, F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(~(F.coalesce("around", F.lit(0)) * 100 >= F.col("a") * absorbed))
    # The best of each part of a language first, so that the last ranking gets few rows however large the language is.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    best = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= reported)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= reported).select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
