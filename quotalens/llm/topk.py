"""Exact top-k inner products through norm buckets.

Vectors are grouped by length into buckets, and large buckets into blocks of bounded size. A query's k-th best product
with the longest vectors is a first threshold t. For a bucket whose longest vector has length l, t / (|q| l) is the cosine
a partner in it needs at least: above 1 the query skips the whole bucket. Otherwise the bucket is pruned for this query
by coordinates when that local threshold is high (a partner's largest coordinates must lie in a narrow range), or by length
when it is low (partners shorter than t / |q| are out). What is left is verified with exact integer products.

Components become floor(256 x). A vector that is null, or holds a null, NaN or infinite component, takes no part, and so
does a row with a null id. Rows that repeat id and vector count once. Vectors meet only vectors of the same dimension;
empty ones have product 0. A candidate with the query's id is the query itself. Ties go to the smaller id. Extra columns
are left out; an empty table gives an empty result. Products must fit 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalens.llm.common import by_value, Shared

by_value(__name__)

#: Length buckets of the table, rows of a block, queries of a block, and longest vectors that give the first threshold.
BUCKETS, BLOCK, QUERY_BLOCK, SEEDS = 32, 4096, 512, 2048

#: Local cosine threshold from which coordinates prune better than length, and coordinates looked at.
COORDINATES_FROM, FOCUS = 0.3, 4

SCALE = 256


def quantized(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, size, norm2) of the rows that take part."""
    x = F.col(vector)
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == math.inf))
    rows = df.filter(F.col(vec_id).isNotNull() & x.isNotNull()).filter(whole)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).distinct()
    return rows.withColumns({
        "size": F.size("v"), "norm2": F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))})


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through floats while every partial sum is exact in them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[-1]
    if most < 2 ** 53:
        return np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def retrieve(q: np.ndarray, own: int, threshold: float, ids: np.ndarray, c: np.ndarray, lengths: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The at most k best (id, score) of a block that reach ``threshold``. ``lengths`` fall."""
    norm = math.sqrt(float((q.astype(np.float64) ** 2).sum()))
    left = np.arange(len(ids))
    if threshold > -math.inf and len(ids):
        local = threshold / (norm * lengths[0]) if norm * lengths[0] > 0 else (0.0 if threshold <= 0 else 2.0)
        if local > 1 + 1e-9:
            return []
        if threshold > 0:
            left = left[:np.searchsorted(-lengths, -(threshold / norm) * (1 - 1e-9), side="right")]
        if local >= COORDINATES_FROM:
            unit = q / norm
            for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
                spread = math.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - unit[f] * unit[f]))
                low, high = unit[f] * local - spread, unit[f] * local + spread
                if unit[f] > 0 and local < unit[f]:
                    high = 1.0
                if unit[f] < 0 and local < -unit[f]:
                    low = -1.0
                x = c[left, f] / np.maximum(lengths[left], 1e-300)
                left = left[(x >= low - 1e-9) & (x <= high + 1e-9)]
    left = left[ids[left] != own]
    if not len(left):
        return []
    scores = _product(q[None, :], c[left])[0]
    keep = scores >= threshold
    left, scores = left[keep], scores[keep]
    return [(int(ids[left[j]]), int(scores[j])) for j in _best(scores, ids[left], k)]


def _matrix(vectors, size: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), size)


def top_k(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row that satisfies ``queries`` (on ``vec_id``), its k best partners: query_id, rank, vec_id, score."""
    rows = quantized(df, vec_id, vector)
    asked = rows.filter(queries)
    sizes = [r[0] for r in rows.select("size").distinct().collect()]  # dimensions in use

    # The longest vectors of each dimension: SEEDS rows each, whatever the table holds.
    seeds = {}
    for size in sizes:
        longest = rows.filter(F.col("size") == size).orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).toPandas()
        seeds[size] = (longest["vec_id"].to_numpy(), _matrix(longest["v"].tolist(), size))
    shared = Shared(df, seeds)

    def first_threshold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            limits = []
            for own, v, size in zip(part["vec_id"], part["v"], part["size"]):
                ids, block = shared.value[size]
                scores = _product(np.asarray(v, np.int64)[None, :], block)[0][ids != own]
                limits.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -math.inf)
            yield part.assign(threshold=limits)

    asked = asked.mapInPandas(first_threshold, "vec_id long, v array<long>, size int, norm2 double, threshold double")

    # Buckets by length. Their bounds and counts are BUCKETS rows a dimension.
    bounds = rows.approxQuantile("norm2", [i / BUCKETS for i in range(1, BUCKETS)], 0.002) if sizes else []
    cut = F.lit(0)
    for b in sorted(set(bounds)):
        cut = cut + (F.col("norm2") > b).cast("int")
    placed = rows.withColumn("bucket", cut)
    held = placed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("longest2"))
    held = held.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.join(F.broadcast(held), ["size", "bucket"])  # BUCKETS rows a dimension
    block = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("blocks")).cast("int")).groupBy("size", "bucket", "block").agg(
        F.collect_list(F.struct("vec_id", "v", "norm2")).alias("held"))

    # Queries in blocks, each sent to the blocks of the buckets that can still hold a partner for one of its queries.
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    reach = F.sqrt(F.col("norm2")) * F.sqrt(F.col("longest2")) * (1 + 1e-9)
    wanted = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(n_blocks)).cast("int")).join(
        F.broadcast(held), "size").filter(F.col("threshold") <= reach)
    parts = wanted.groupBy("size", "bucket", "blocks", "part").agg(F.collect_list(F.struct("vec_id", "v", "threshold")).alias("asked"))
    meet = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(block, ["size", "bucket", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, asked_here, held_here = (batch.column(c)[row] for c in range(3))
                size, (ids, c, norm2), (own, q, limits) = size.as_py(), _columns(held_here, size.as_py()), _columns(asked_here, size.as_py())
                order = np.lexsort((ids, -norm2))
                ids, c, lengths = ids[order], c[order], np.sqrt(norm2[order])
                found = [(int(a), *x) for a, v, t in zip(own, q, limits) for x in retrieve(v, a, t, ids, c, lengths, k)]
                yield pa.RecordBatch.from_pydict(
                    {n: [x[i] for x in found] for i, n in enumerate(("query_id", "vec_id", "score"))},
                    pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")]))

    near = meet.select("size", "asked", "held").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _columns(held: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, matrix and the third field of a packed block."""
    ids, v, third = (held.values.field(i) for i in range(3))
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(), flat.reshape(len(ids), size), third.to_numpy()
