"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text is lower-cased; its words are cut into byte n-grams with word edges, hashed into buckets. The mean of the buckets'
vectors goes through a linear softmax. Both are trained in numpy by stochastic gradient descent on a bounded sample of
labelled rows (``SAMPLE`` rows a language, ``SNIPPET`` characters of each); a part of the sample is kept aside to fit the
temperature and the rejection limit. Prediction reads every text whole: since the network is linear behind the mean,
each bucket's contribution to each language is a table, and a text is a sum over its n-grams.

A null text or one without a letter is ``und`` with score 0 and rejected. Without any labelled row every text is. Labels
that are null are not learned. Repeated rows and ids are predicted one by one; extra columns stay; an empty table gives
an empty result. Ties between languages go to the one that sorts first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field, held_out, sample_order, seeded, Shared

by_value(__name__)

#: Rows a language and characters a row used for training at most, and the share kept aside for calibration.
SAMPLE, SNIPPET, ASIDE = 800, 1000, 0.25

BITS, SIZE, EPOCHS, BATCH, RATE = 16, 16, 6, 32, 8.0

#: A prediction below this calibrated probability is rejected, or below the limit that keeps all but so many of the
#: calibration rows, if that is lower.
CONFIDENT, LOST = 0.5, 0.001

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_PIECE = 1 << 18

#: Bytes whose n-grams are looked up at a time, and bytes of texts in one part of a batch.
_AT_ONCE, _SLICE = 1 << 16, 4 << 20


@dataclass
class LanguageModel:
    """table: bucket -> logit of each language and a one that counts (last row: nothing)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float


def pieces(text: str) -> list[bytes]:
    """The words of a text with blanks around them, in parts of bounded size."""
    data = text.lower().encode().translate(_BLANK)
    parts, at = [], 0
    while at < len(data):
        end = len(data) if at + _PIECE >= len(data) else data.find(b" ", at + _PIECE) % (1 << 63)
        end = min(end, at + 2 * _PIECE, len(data))
        parts.append(b" " + data[at:end] + b" ")
        at = end
    return parts


def buckets(data: bytes) -> np.ndarray:
    """Buckets of all n-grams of 2 to 4 bytes inside words, edges included; others get the last number."""
    a = np.frombuffer(data, np.uint8)
    blank = a == 0x20
    code = a.astype(np.uint32)
    out = []
    inside = np.zeros(len(a), bool)
    for n in (2, 3, 4):
        if len(a) < n:
            break
        code = (code[:-1] << np.uint32(8)) | a[n - 1:]
        if n > 2:
            inside = inside[:-1] | blank[n - 2:len(a) - 1]
        else:
            inside = blank[:-1] & blank[1:]
            both, inside = inside, np.zeros(len(code), bool)
        bucket = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)
        bucket[both if n == 2 else inside] = 1 << BITS
        out.append(bucket)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def train(texts: list[str], labels: list[str]) -> LanguageModel | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seeded("language"))
    ids = [np.concatenate([buckets(p) for p in pieces(t)] or [np.zeros(0, np.uint32)]) for t in texts]
    ids = [x[x < 1 << BITS].astype(np.int64) for x in ids]
    y = np.array([languages.index(x) for x in labels])
    usable = np.array([k for k in range(len(ids)) if len(ids[k])], int)
    rng.shuffle(usable)
    cut = int(len(usable) * ASIDE) if len(usable) >= 20 else 0
    aside, fit = usable[:cut], usable[cut:]
    n = len(languages)
    vectors = rng.normal(0, 0.1, (1 << BITS, SIZE))
    out, bias = rng.normal(0, 0.1, (SIZE, n)), np.zeros(n)
    steps, done = max(1, EPOCHS * -(-len(fit) // BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rows = fit[at:at + BATCH]
            flat = np.concatenate([ids[k] for k in rows])
            sizes = np.array([len(ids[k]) for k in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(vectors[flat], starts) / sizes[:, None]
            p = _softmax(hidden @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            rate = RATE * (1 - done / steps) / len(rows)
            back = np.repeat(p @ out.T / sizes[:, None], sizes, axis=0)
            out -= rate * hidden.T @ p
            bias -= rate * p.sum(0)
            for d in range(SIZE):
                vectors[:, d] -= rate * len(rows) * np.bincount(flat, back[:, d], minlength=1 << BITS)
            done += 1
    logits = np.zeros(((1 << BITS) + 1, n + 1), np.float32)
    logits[:-1, :n], logits[:-1, n] = vectors @ out, 1
    model = LanguageModel(languages, logits, bias, 1.0, CONFIDENT)
    if cut:
        raw = np.array([_logits(model, [texts[k]])[0] for k in aside])
        heat = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
        loss = [-np.mean(np.log(_softmax(raw / t)[np.arange(cut), y[aside]] + 1e-12)) for t in heat]
        model.temperature = heat[int(np.argmin(loss))]
        sure = np.sort(_softmax(raw / model.temperature).max(1))
        model.limit = float(min(CONFIDENT, sure[int(LOST * cut)]))
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _logits(model: LanguageModel, texts: list[str]) -> np.ndarray:
    sums = np.zeros((len(texts), model.table.shape[1]))
    waiting: list[tuple[int, bytes]] = []

    def flush():
        if waiting:
            groups = [buckets(p) for _, p in waiting]
            sizes = np.array([len(g) for g in groups])
            part = np.add.reduceat(model.table[np.concatenate(groups)], np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.float64)
            np.add.at(sums, [k for k, _ in waiting], part)
            waiting.clear()

    size = 0
    for k, text in enumerate(texts):
        for p in pieces(text):
            waiting.append((k, p))
            size += len(p)
            if size >= _AT_ONCE:
                flush()
                size = 0
    flush()
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    names, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
    known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if model else []
    if known:
        p = _softmax(_logits(model, [texts[k] for k in known]) / model.temperature)
        for k, row in zip(known, p):
            best = int(row.argmax())
            names[k], scores[k], rejected[k] = model.languages[best], float(row[best]), bool(row[best] < model.limit)
    return names, scores, rejected


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel | None:
    """Train on rows outside the held-out third. The sample is drawn by a hash of the row, so it is always the same."""
    rows = df.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * SAMPLE / n))])
    order = sample_order(doc_id, lang)
    room = F.greatest(F.length(text) - SNIPPET, F.lit(0)) + 1
    drawn = rows.filter(F.pmod(order, F.lit(1_000_003)) < F.element_at(share, F.col(lang)) * 1_000_003).select(
        F.col(lang).alias("lang"), order.alias("at"), F.substring(text, (F.pmod(order, room) + 1).cast("int"), F.lit(SNIPPET)).alias("snippet"))
    sample = drawn.toPandas().sort_values(["lang", "at", "snippet"]).groupby("lang").head(SAMPLE)
    return train(sample["snippet"].tolist(), sample["lang"].tolist())


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability) and ``rejected``. The model's size is fixed: it is broadcast."""
    shared = Shared(df, model)

    def start():
        return lambda texts: list(predict(shared.value, texts))

    return append_columns(df, text, [field("lang_pred", "string"), field("score", "double"), field("rejected", "boolean")], start, keep, target=_SLICE)
