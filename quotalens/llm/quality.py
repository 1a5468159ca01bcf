"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector. Learned filters of eight bytes slide over the whole document four bytes at a time; over
each chunk of 128 bytes (chunks overlap by half) the strongest response of each filter is kept. The mean, the
maximum and the minimum of the chunks' responses are combined into one probability. Documents of any length are read whole, block by block, with
bounded memory.

Trained by back-propagation with Adam on a bounded sample of labelled rows (``SAMPLE`` a class, ``SNIPPET`` characters of
each), never on held-out rows. Null and empty texts score what the network says to no input at all. Rows whose labels
contradict each other or are null are not learned from; if fewer than two classes are known every score is their mean
(0.5 without labels). Repeated rows are scored one by one; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field, fold, sample_order, seeded, Shared

by_value(__name__)

#: Rows a class and characters a row used for training at most.
SAMPLE, SNIPPET = 1000, 2500

VECTOR, STRIDE, FILTERS, HALF, EPOCHS, BATCH, RATE = 6, 4, 24, 64, 10, 16, 0.006
_BLOCK = 1 << 17


class Network:
    """One set of weights; ``constant`` stands in where nothing could be learned."""

    def __init__(self, constant: float | None = None):
        rng = np.random.default_rng(seeded("quality"))
        make = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.w = {
            "vectors": make(256, VECTOR), "first": make(STRIDE * VECTOR, FILTERS), "second": make(STRIDE * VECTOR, FILTERS),
            "shift": np.zeros(FILTERS, np.float32), "out": make(3 * FILTERS), "bias": np.zeros(1, np.float32),
        }
        self.constant = constant

    def _rows(self, data: np.ndarray) -> np.ndarray:
        return self.w["vectors"][data].reshape(-1, STRIDE * VECTOR)

    def _responses(self, rows: np.ndarray) -> np.ndarray:
        """Response of each filter at each step; ``rows`` has one row more than there are steps."""
        y = rows[:-1] @ self.w["first"]
        y += rows[1:] @ self.w["second"]
        y += self.w["shift"]
        return np.maximum(y, 0, out=y)

    def halves(self, data: bytes) -> np.ndarray:
        """Strongest responses in each half chunk of the document; blank bytes fill the last one."""
        a = np.frombuffer(data, np.uint8)
        out = []
        for at in range(0, len(a), _BLOCK):
            part = a[at:at + _BLOCK + STRIDE]
            size = -(-min(_BLOCK, len(a) - at) // HALF) * HALF
            full = np.full(size + STRIDE, 0x20, np.uint8)
            full[:len(part)] = part
            out.append(self._responses(self._rows(full)).reshape(-1, HALF // STRIDE, FILTERS).max(1))
        return np.concatenate(out) if out else np.zeros((1, FILTERS), np.float32)

    def score(self, data: bytes) -> float:
        if self.constant is not None:
            return self.constant
        half = self.halves(data)
        chunks = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
        z = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)]) @ self.w["out"] + self.w["bias"][0]
        return float(1 / (1 + np.exp(-np.float64(z))))

    def gradient(self, data: bytes, label: int) -> dict[str, np.ndarray]:
        size = max(1, -(-len(data) // HALF)) * HALF
        full = np.full(size + STRIDE, 0x20, np.uint8)
        full[:len(data)] = np.frombuffer(data, np.uint8)
        rows = self._rows(full)
        y = self._responses(rows)
        steps = HALF // STRIDE
        half = y.reshape(-1, steps, FILTERS)
        best, top = half.argmax(1) + steps * np.arange(len(half))[:, None], half.max(1)
        if len(top) > 1:
            left = top[:-1] >= top[1:]
            chunks, place = np.where(left, top[:-1], top[1:]), np.where(left, best[:-1], best[1:])
        else:
            chunks, place = top, best
        pooled = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)])
        z = pooled @ self.w["out"] + self.w["bias"][0]
        error = np.float32(1 / (1 + np.exp(-np.float64(z))) - label)
        back = error * self.w["out"]
        grad = np.tile(back[:FILTERS] / len(chunks), (len(chunks), 1))
        every = np.arange(FILTERS)
        grad[chunks.argmax(0), every] += back[FILTERS:2 * FILTERS]
        grad[chunks.argmin(0), every] += back[2 * FILTERS:]
        dy = np.zeros_like(y)
        np.add.at(dy, (place, np.broadcast_to(every, place.shape)), grad)
        dy *= y > 0
        dx = np.zeros_like(rows)
        dx[:-1] += dy @ self.w["first"].T
        dx[1:] += dy @ self.w["second"].T
        dv = np.zeros_like(self.w["vectors"])
        np.add.at(dv, full, dx.reshape(-1, VECTOR))
        return {
            "vectors": dv, "first": rows[:-1].T @ dy, "second": rows[1:].T @ dy, "shift": dy.sum(0),
            "out": error * pooled, "bias": np.array([error]),
        }


def train(texts: list[str], labels: list[int]) -> Network:
    kinds = set(labels)
    if len(kinds) < 2:
        return Network(constant=float(kinds.pop()) if kinds else 0.5)
    net, rng = Network(), np.random.default_rng(seeded("order"))
    data = [t.encode() for t in texts]
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            grads = [net.gradient(data[k], labels[k]) for k in rows]
            step += 1
            for k, w in net.w.items():
                g = sum(x[k] for x in grads) / len(rows)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w -= RATE * (0.8 ** epoch) * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """Train on labelled rows whose fold is not 1. At most ``SAMPLE`` rows a class reach the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & (fold("doc_id") != 1) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).alias("least"), F.max(label).alias("label")).filter(F.col("least") == F.col("label")).select("doc_id", "label")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * SAMPLE / n))])
    order = sample_order("doc_id")
    drawn = known.filter(F.pmod(order, F.lit(1_000_003)) < F.element_at(share, F.col("label")) * 1_000_003)
    chosen = drawn.withColumn("at", order).toPandas().sort_values(["label", "at"]).groupby("label").head(SAMPLE)
    few = docs.sparkSession.createDataFrame(chosen[["doc_id", "label", "at"]].astype("int64"), "doc_id long, label long, at long")
    room = F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(  # few is bounded by SAMPLE
        F.first("label").alias("label"), F.min(F.substring("text", (F.pmod("at", room) + 1).cast("int"), F.lit(SNIPPET))).alias("snippet"))
    sample = rows.toPandas().sort_values("doc_id")
    return train(sample["snippet"].fillna("").tolist(), sample["label"].tolist())


def score_quality(df: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted``. The network's size is fixed: it is broadcast."""
    shared = Shared(df, net)

    def start():
        def work(texts):
            scores = [shared.value.score((t or "").encode()) for t in texts]
            return [scores, [int(s >= 0.5) for s in scores]]

        return work

    return append_columns(df, text, [field("score", "double"), field("predicted", "int")], start, keep)
