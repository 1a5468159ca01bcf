"""Fill-in-the-middle: a document is cut at two places and its middle is moved to the end.

Places are counted in units: a run of ASCII letters is one unit, every other code point is one. The code points of a batch
are sorted into four classes (first letter of a run, further letter, white space, anything else), and a wavelet matrix over
the classes answers how many of a class stand before a place (rank). Ranks of the classes that begin a unit add up to the
number of units begun, which grows with the place, so a bisection on it finds the place where a wanted number of units
ends. All cuts of a batch are bisected together; a document needs as many steps as its length has bits.

The two cuts and the form come from four 32-bit numbers, taken from the SHA-256 of ``epoch:key``, so that rows can be
repeated anywhere and another epoch gives other cuts.

Null and empty texts are empty, have no unit and stay plain, and so does a text that contains one of the marks. A null key
counts as an empty one. Rows that repeat a key have the same numbers. Columns of the input that bear the name of a new
column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import by_value, slices

by_value(__name__)

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"

#: Classes of code points. All but ``INNER`` begin a unit.
FIRST, INNER, SPACE, OTHER = range(4)
BEGINS = (FIRST, SPACE, OTHER)

_SPACES = np.array([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20], np.uint32)


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every code point; ``starts`` are the places at which documents begin, where no run goes on."""
    letter = ((points | np.uint32(0x20)) - np.uint32(0x61)) < 26
    after = np.zeros(len(points), bool)
    after[1:] = letter[:-1]
    after[starts[starts < len(points)]] = False
    out = np.full(len(points), OTHER, np.uint8)
    out[np.isin(points, _SPACES)] = SPACE
    out[letter] = FIRST
    out[letter & after] = INNER
    return out


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one bit vector a level, zeros of a level moved before its ones."""

    def __init__(self, symbols: np.ndarray, levels: int = 2):
        self.levels = []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            padded[:len(packed)] = packed
            words = padded.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((level, words, before, len(bit) - int(before[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before each place."""
        low, high = np.zeros_like(at), at
        for level, words, before, zeros in self.levels:
            ones = [before[x >> 6] + np.bitwise_count(words[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))) for x in (low, high)]
            low, high = [zeros + n if symbol >> level & 1 else x - n for x, n in zip((low, high), ones)]
        return high - low

    def begun(self, at: np.ndarray) -> np.ndarray:
        """How many units begin before each place."""
        return sum(self.rank(c, at) for c in BEGINS)


def cut_places(texts: Sequence[str | None], one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before the smaller and the larger cut; the numbers are taken modulo units + 1."""
    texts = [t or "" for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size) - size
    matrix = WaveletMatrix(classes(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), starts))
    base = matrix.begun(starts)
    units = matrix.begun(starts + size) - base
    places = []
    for wanted in np.sort(np.stack([one % (units + 1), two % (units + 1)]), axis=0):
        low, high = np.zeros(len(size), np.int64), size.copy()
        while (low < high).any():  # the last place before which no more than the wanted units begin
            middle = (low + high + 1) >> 1
            fits = matrix.begun(starts + middle) - base <= wanted
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        places.append(low)
    return units, places[0], places[1]


_CUTS = "struct<units: bigint, first: bigint, second: bigint>"


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        done = []
        for piece in slices(pa.RecordBatch.from_arrays(list(columns), names=["text", "one", "two"]), 4 << 20):
            one, two = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            done.append(cut_places(piece.column(0).to_pylist(), one, two))
        joined = [np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in range(3)]
        yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in joined], names=["units", "first", "second"])


def numbers(key: str, epoch: int) -> list[Column]:
    """The first four groups of eight digits of the hash, as numbers."""
    name = F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", epoch: int = 1, plain_percent: int = 10, suffix_first_percent: int = 20,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """``df`` with n (units), form, prefix_chars, middle_chars (null if plain) and output, the text to train on.

    ``plain_percent`` of the documents stay plain; of the others, ``suffix_first_percent`` put the suffix first.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    work = F.arrow_udf(_cuts, _CUTS)
    body = F.coalesce(F.col(text), F.lit(""))
    one, two, three, four = numbers(key, epoch)
    prefix_mark, suffix_mark, middle_mark = (F.lit(m) for m in marks)
    plain = (body == "") | (three % 100 >= 100 - plain_percent)
    for m in marks:
        plain = plain | F.contains(body, F.lit(m))
    form = F.when(plain, PLAIN).when(four % 100 < suffix_first_percent, SUFFIX_FIRST).otherwise(PREFIX_FIRST)
    kept = [F.col(c) for c in df.columns if c.lower() not in new]
    made = df.select(*kept, F.struct(body.alias("body"), form.alias("form"), work(body, one, two).alias("cut")).alias("output"))
    at = F.col("output")
    body, form, first, second = at["body"], at["form"], at["cut"]["first"], at["cut"]["second"]
    prefix, middle = F.substring(body, F.lit(1), first.cast("int")), F.substring(body, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(body, (second + 1).cast("int"), F.length(body))
    arranged = F.when(form == PLAIN, body).when(
        form == SUFFIX_FIRST, F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)).otherwise(
        F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
    return made.select(
        *kept, at["cut"]["units"].alias("n"), form.alias("form"), F.when(form != PLAIN, first).alias("prefix_chars"),
        F.when(form != PLAIN, second - first).alias("middle_chars"), arranged.alias("output"))


def restored(output: str = "output", form: str = "form", marks: Sequence[str] = MARKS) -> Column:
    """The text from its output and form alone. No mark stands in a text that was cut, so each is found where it was put."""
    whole, kind = F.col(output), F.col(form)
    middle = F.substring_index(whole, marks[2], -1)
    front = F.substring_index(whole, marks[2], 1)

    def parts(head: str, tail: str) -> tuple[Column, Column]:
        return F.substring_index(F.substring_index(front, tail, 1), head, -1), F.substring_index(front, tail, -1)

    prefix, suffix = parts(marks[0], marks[1])
    late_suffix, late_prefix = parts(marks[1], marks[0])
    return F.when(kind == PLAIN, whole).when(kind == SUFFIX_FIRST, F.concat(late_prefix, middle, late_suffix)).otherwise(F.concat(prefix, middle, suffix))
