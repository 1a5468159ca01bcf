"""Repeated substrings: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

Every string of that length has one anchor, the left-most of its ``GRAM``-byte grams with the smallest hash; the strings of
a document that share an anchor are consecutive. Equal strings have equal anchors at equal offsets, so it is enough to
compare strings inside such a slot. The job has three exchanges:

1. Gram hashes of all anchors are dealt by hash; anchors whose gram stands in one document only are done.
2. The other anchors' surroundings (all strings of the anchor and nothing more) are dealt by the same hash. In each slot
   the suffixes are sorted by a merge sort whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes, in logarithmic time. Neighbours that agree over the whole length are compared byte by
   byte, so that hash collisions can't remove anything. The smallest id of a run of equal strings decides.
3. The removed ranges go back to their documents.

Copies are settled early: of equal texts in one task only the smallest id takes part, of equal surroundings likewise, the
others follow from it. What is exchanged is compressed.

Null texts are empty. Null ids take no part: nothing is removed from such a row and nothing because of it. Rows that repeat
an id are one document each; they don't remove each other's bytes. Extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field, settled, slices

by_value(__name__)

LENGTH, GRAM = 50, 18
SPAN = LENGTH - GRAM + 1

#: Bytes of text whose anchors go to one bucket on average.
BUCKET_BYTES = 2 << 20

#: Bytes of surroundings whose strings are compared at a time; a gram's are never parted.
PART_BYTES = 256 << 10

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Prefix polynomial hashes modulo 2^64 of a byte string; the base is odd and so has an inverse."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes.up) <= n:
            size = max(n + 1, 2 * len(Hashes.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(Hashes, name, np.cumprod(x, dtype=np.uint64))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes.up[:n], dtype=np.uint64, out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * Hashes.down[start]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, gram hashes, and first and last start of the strings of each anchor."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    h = Hashes(data)
    n = len(data) - GRAM + 1
    gram = mix((h.total[GRAM:] - h.total[:n]) * Hashes.down[:n])
    low, at, width = gram, np.arange(n), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        width += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], gram[at[first]], first, last


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, the first bytes of all numbers of an array before the second ones: high bytes hardly differ."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = pa.decompress(blob[8 * len(kinds):], int(sum(n * w for n, w in zip(sizes, widths))), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, w, k in zip(sizes, widths, kinds):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def shortened(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40 bits, low ones first, that tell grams of a bucket apart; a chance hit only costs work."""
    short = mix(gram + np.uint64(_BASE))
    return short.astype(np.uint32), (short >> np.uint64(32)).astype(np.uint8)


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors have the smallest hashes of their strings, so the hash is mixed anew to deal them evenly."""
    return ((mix(gram + np.uint64(_BASE)) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def by_bucket(gram: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers and the places of their grams, ordered by gram."""
    number = bucket_of(gram, buckets)
    order = np.lexsort((gram, number))
    cut = np.flatnonzero(np.diff(number[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(number[part[0]]), part


# --- Exchange 1: grams that stand in several documents ----------------------------------------------------------

def _deal_grams(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[bytes, int] = {}
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                ids, keys, grams, places, owners = [], [], [], [], []
                for doc, key, text in zip(*(c.to_pylist() for c in piece.columns)):
                    data = text.encode()
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    if smallest.get(digest, doc + 1) <= doc:  # a copy of a smaller one in this task
                        continue
                    smallest[digest] = doc
                    _, gram, _, _ = anchors(np.frombuffer(data, np.uint8))
                    grams.append(gram)
                    places.append(np.arange(len(gram), dtype=np.uint32))
                    owners.append(np.full(len(gram), len(ids), np.uint32))
                    ids.append(doc)
                    keys.append(key)
                gram = np.concatenate(grams or [np.zeros(0, np.uint64)])
                if not len(gram):
                    continue
                place, owner, ids, keys = np.concatenate(places), np.concatenate(owners), np.array(ids, np.int64), np.array(keys, np.int32)
                rows = []
                for bucket, part in by_bucket(gram, buckets):
                    used, local = np.unique(owner[part], return_inverse=True)
                    rows.append((bucket, pack(*shortened(gram[part]), local.astype(np.uint32), place[part], ids[used], keys[used])))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

    return run


def _shared_grams(part: pd.DataFrame) -> pd.DataFrame:
    """For each document of the bucket, the numbers of its anchors whose gram stands in another document too."""
    grams, owners, places, ids, keys, n = [], [], [], [], [], 0
    for blob in part["blob"]:
        low, high, owner, place, doc, key = unpack(blob, "u4", "u1", "u4", "u4", "i8", "i4")
        grams.append(joined(low, high))
        owners.append(owner.astype(np.int64) + n)
        places.append(place)
        ids.append(doc)
        keys.append(key)
        n += len(doc)
    gram, owner, place, doc, key = map(np.concatenate, (grams, owners, places, ids, keys))
    order = np.argsort(gram, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(gram[order]) != 0]))
    id_of = doc[owner[order]]
    sizes = np.diff(np.append(first, len(order)))
    several = np.minimum.reduceat(id_of, first) != np.maximum.reduceat(id_of, first)
    hot = order[np.repeat(several, sizes)]
    hot = hot[np.argsort(owner[hot], kind="stable")]
    cut = np.flatnonzero(np.diff(owner[hot])) + 1
    groups = [g for g in np.split(hot, cut) if len(g)]
    return pd.DataFrame({
        "doc_id": [int(doc[owner[g[0]]]) for g in groups], "key": [int(key[owner[g[0]]]) for g in groups],
        "places": [place[g].astype("<u4").tobytes() for g in groups]})


# --- Exchange 2: equal strings among the surroundings -------------------------------------------------------------

def _deal_surroundings(buckets: int):
    """Rows of (bucket, blob) for the sort, and of (doc_id, key, ranges) for what is settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[bytes, int] = {}
        for batch in batches:
            for piece in slices(batch, 2 << 20):
                ids, keys, held, settled = [], [], [], []
                for doc, key, packed, places in zip(*(c.to_pylist() for c in piece.columns)):
                    data = np.frombuffer(unzip(packed), np.uint8)
                    at, gram, first, last = anchors(data)
                    raw = data.tobytes()
                    done = []
                    for k in np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in places])).tolist():
                        a, b = int(first[k]), int(last[k])
                        around = raw[a:b + LENGTH]
                        name = hashlib.blake2b(around, digest_size=16, key=int(at[k] - a).to_bytes(8, "little")).digest()
                        known = smallest.get(name)
                        if known is not None and known < doc:
                            done += [a, b]
                            continue
                        if len(smallest) >= 300_000:  # more would only settle more copies here
                            smallest.clear()
                        smallest[name] = doc
                        held.append((gram[k], len(ids), a, at[k] - a, len(around), around))
                    ids.append(doc)
                    keys.append(key)
                    if done:
                        settled.append((doc, key, done))
                rows = []
                if held:
                    gram, owner, start, offset, size = (np.array([h[i] for h in held], t) for i, t in enumerate(("u8", "u4", "u4", "u1", "u1")))
                    ids, keys = np.array(ids, np.int64), np.array(keys, np.int32)
                    for bucket, part in by_bucket(gram, buckets):
                        used, local = np.unique(owner[part], return_inverse=True)
                        text = np.frombuffer(b"".join(held[i][5] for i in part), np.uint8)
                        rows.append((bucket, pack(*shortened(gram[part]), local.astype(np.uint32), start[part], offset[part], size[part], ids[used], keys[used], text)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in rows] + [-1] * len(settled), pa.int64()), pa.array([x for _, x in rows] + [None] * len(settled), pa.binary()),
                    pa.array([0] * len(rows) + [s[0] for s in settled], pa.int64()), pa.array([0] * len(rows) + [s[1] for s in settled], pa.int32()),
                    pa.array([None] * len(rows) + [s[2] for s in settled], pa.list_(pa.int32()))], names=["bucket", "blob", "doc_id", "key", "ranges"])

    return run


def _extension(h: Hashes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes i and j, LENGTH at most, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), np.full(len(i), LENGTH, np.int64)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = h.of(i, middle) == h.of(j, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sort_suffixes(data: np.ndarray, h: Hashes, start: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Order of the suffixes: by slot (given in order), inside a slot by merge sort with hash comparisons."""
    order = np.arange(len(start))
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    sizes = np.diff(np.append(first, len(slot)))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    place = np.arange(len(slot)) - base
    run = 1
    while run < sizes.max(initial=0):
        live = np.flatnonzero(size > run)
        own = place[live] // run
        mate = own ^ 1
        mate_at = base[live] + mate * run
        low, high = np.zeros(len(live), np.int64), np.clip(size[live] - mate * run, 0, run)
        mine = start[order[live]]
        while True:  # how many of the mate's suffixes come first
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            other = start[order[mate_at[open_] + middle]]
            common = _extension(h, mine[open_], other)
            full = common == LENGTH
            step = np.where(full, 0, common)
            before = np.where(full, mate[open_] < own[open_], data[other + step] < data[mine[open_] + step])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        target = base[live] + np.minimum(own, mate) * run + (place[live] - own * run) + low
        new = order.copy()
        new[target] = order[live]
        order = new
        run *= 2
    return order


def _equal_strings(part: pd.DataFrame) -> pd.DataFrame:
    """Ranges of starts, (first, last) pairs, of the strings that also stand in a document with a smaller id.

    Slots of different grams never meet, so a bucket is worked through in parts of whole grams of about ``PART_BYTES``.
    """
    columns = [[] for _ in range(8)]
    docs = 0
    for blob in part["blob"]:
        low, high, *found = unpack(blob, "u4", "u1", "u4", "u4", "u1", "u1", "i8", "i4", "u1")
        found = [joined(low, high), found[0] + np.uint32(docs), *found[1:]]
        docs += len(found[5])
        for column, x in zip(columns, found):
            column.append(x)
    gram, owner, begin, offset, size, ids, keys, data = map(np.concatenate, columns)
    del columns
    size = size.astype(np.int64)
    text_at = np.cumsum(size) - size
    order = np.argsort(gram, kind="stable")
    upto = np.cumsum(size[order])
    new = np.flatnonzero(np.diff(gram[order])) + 1  # a part may end before these
    rows: list[tuple[int, list[int]]] = []
    at = 0
    while at < len(order):
        done = upto[at - 1] if at else 0
        k = np.searchsorted(new, max(at + 1, np.searchsorted(upto, done + PART_BYTES)))
        end = int(new[k]) if k < len(new) else len(order)
        some = order[at:end]
        rows += _equal_in(gram[some], owner[some], begin[some].astype(np.int64), offset[some].astype(np.int64), size[some], ids, data, text_at[some])
        at = end
    return pd.DataFrame({"doc_id": [int(ids[k]) for k, _ in rows], "key": [int(keys[k]) for k, _ in rows], "ranges": [r for _, r in rows]})


def _equal_in(
    gram: np.ndarray, owner: np.ndarray, begin: np.ndarray, offset: np.ndarray, size: np.ndarray, ids: np.ndarray, data: np.ndarray, text_at: np.ndarray,
) -> list[tuple[int, list[int]]]:
    """The same for some surroundings, ordered by gram: places of documents and their ranges."""
    own_at = np.cumsum(size) - size
    data = data[np.repeat(text_at - own_at, size) + np.arange(int(size.sum()))]
    count = size - LENGTH + 1
    entry = np.repeat(np.arange(len(gram)), count)
    shift = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    away = offset[entry] - shift  # offset of the anchor in the string
    number = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))
    slot = number[entry] * (SPAN + 1) + away
    h = Hashes(data)
    start = own_at[entry] + shift
    whole = h.of(start, LENGTH)
    # Equal strings are sorted as one; a string whose hash over the whole length is its own in the slot equals no other.
    order = np.lexsort((whole, slot))
    change = np.flatnonzero(np.concatenate([[True], (slot[order][1:] != slot[order][:-1]) | (whole[order][1:] != whole[order][:-1])]))
    several = np.diff(np.append(change, len(order)))
    head, several = change[several > 1], several[several > 1]
    if not len(head):
        return []
    ranked = sort_suffixes(data, h, start[order[head]], slot[order[head]])
    head, several = head[ranked], several[ranked]
    order = order[np.repeat(head - (np.cumsum(several) - several), several) + np.arange(int(several.sum()))]
    entry, shift, slot, start = entry[order], shift[order], slot[order], start[order]
    same = np.zeros(len(start), bool)
    near = np.flatnonzero(slot[1:] == slot[:-1]) + 1
    near = near[whole[order[near]] == whole[order[near - 1]]]
    for at in range(0, len(near), 1 << 16):  # the bytes decide
        some = near[at:at + (1 << 16)]
        step = np.arange(LENGTH)
        same[some] = (data[start[some][:, None] + step] == data[start[some - 1][:, None] + step]).all(1)
    first = np.flatnonzero(~same)
    doc = ids[owner[entry]]
    smallest = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
    gone = np.flatnonzero(smallest < doc)
    whose, where = owner[entry[gone]], begin[entry[gone]] + shift[gone]
    order = np.lexsort((where, whose))
    whose, where = whose[order], where[order]
    rows: dict[int, list[int]] = {}
    head = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (where[1:] > where[:-1] + 1)])[:len(whose)])
    for a, b in zip(head, np.append(head[1:], len(whose)) - 1):
        rows.setdefault(int(whose[a]), []).extend((int(where[a]), int(where[b])))
    return list(rows.items())


# --- Exchange 3: documents and their ranges -------------------------------------------------------------------------

def zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def _zip():
    return lambda texts: [[zipped(t.encode()) for t in texts]]


def unzip(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""


def cover(size: int, ranges: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2])):
        end = min(size, b + LENGTH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, runs, kept = [], [], []
        for packed, ranges, copy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            data = unzip(packed)
            spans = [(0, len(data))] if copy and len(data) >= LENGTH else cover(len(data), [x for r in ranges or () for x in r])
            at, left = 0, []
            for a, b in spans:
                left.append(data[at:a])
                at = b
            sizes.append(len(data))
            runs.append([x for s in spans for x in s])
            kept.append(b"".join([*left, data[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): starts and ends of the removed runs in turn, and the bytes that stay."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.hash(body).alias("key"), body.alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_BYTES))

    named = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    grams = named.mapInArrow(settled(_deal_grams(buckets)), "bucket long, blob binary")
    shared = grams.groupBy("bucket").applyInPandas(_shared_grams, "doc_id long, key int, places binary")
    shared = shared.groupBy("doc_id", "key").agg(F.collect_list("places").alias("places"))  # at most the document's anchors

    # Both joins below exchange the same rows, so that Spark deals them once. The inner one asks for keys that aren't null; the filter makes
    # the other one ask for the same.
    packed = append_columns(docs.filter(F.col("doc_id").isNotNull()), "text", [field("packed", "binary")], _zip, ["doc_id", "key"])
    packed = packed.filter(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    met = packed.join(shared, ["doc_id", "key"]).select("doc_id", "key", "packed", "places")
    dealt = met.mapInArrow(settled(_deal_surroundings(buckets)), "bucket long, blob binary, doc_id long, key int, ranges array<int>")
    # A settled row keeps its place: it goes through the same exchange under a number of its own.
    number = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.col("key"), F.lit(buckets)))
    found = dealt.withColumn("bucket", number).groupBy("bucket").applyInPandas(_search, "doc_id long, key int, ranges array<int>")
    ranges = found.groupBy("doc_id", "key").agg(F.collect_list("ranges").alias("ranges"))

    digest = F.sha2(F.col("text").cast("binary"), 256)
    copies = named.select("doc_id", "key", digest.alias("digest"))
    least = copies.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(F.col("least") < F.col("most"))
    copies = copies.join(least, "digest").filter(F.col("doc_id") > F.col("least")).select("doc_id", "key", F.lit(True).alias("copy")).distinct()
    marks = ranges.join(copies, ["doc_id", "key"], "full")
    given = packed.join(marks, ["doc_id", "key"], "left").select("doc_id", "packed", "ranges", F.coalesce("copy", F.lit(False)).alias("copy"))
    rest = append_columns(docs.filter(F.col("doc_id").isNull()), "text", [field("packed", "binary")], _zip, ["doc_id"])
    given = given.unionByName(rest.withColumns({"ranges": F.lit(None).cast("array<array<int>>"), "copy": F.lit(False)}))
    return given.mapInArrow(settled(_cut), "doc_id long, n_bytes long, spans array<int>, kept binary")


def _search(part: pd.DataFrame) -> pd.DataFrame:
    dealt = part[part["blob"].notna()]
    settled = part.loc[part["blob"].isna(), ["doc_id", "key", "ranges"]]
    found = [settled] if len(settled) else []
    if len(dealt):
        found.append(_equal_strings(dealt))
    found = [f for f in found if len(f)]
    nothing = pd.DataFrame({"doc_id": [], "key": [], "ranges": pd.Series(dtype=object)})  # else Arrow takes them for numbers
    return pd.concat(found or [nothing]).astype({"doc_id": "int64", "key": "int32"})
