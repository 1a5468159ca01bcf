"""Licence scan through a positional index of rare template words.

Every licence template is a list of words; the index maps a word to its places in all templates. Document frequencies
of these words over the whole corpus say which are rare. In a file, the rarest words of each template (its anchors) are
looked up first; every occurrence votes for the place at which the template would start, and the votes of a template's
anchors are intersected by that relative position. A surviving alignment counts if the template's mandatory phrase
stands inside it and the words found at their places carry enough of the template's weight (inverse document
frequency).

The base phrases are templates as well, with full coverage required, so their places come out of the same lookup.

A null or empty text has no words and no label. Repeated rows and ids are scanned one by one; extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field as attribute

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field

by_value(__name__)


@dataclass(frozen=True)
class Template:
    """``phrase`` must stand in the file, ``text`` is looked for around it; ``coverage`` is the least share of its weight."""

    label: str
    text: str
    phrase: str
    base: bool = False
    coverage: float = 0.75


# The phrases of the contract.
BASE = (
    Template("mit", "mit license", "mit license", base=True, coverage=1.0),
    Template("apache", "apache license", "apache license", base=True, coverage=1.0),
    Template("gpl", "general public license", "general public license", base=True, coverage=1.0),
)

# Opening or grant sentences of well-known licences.
TEMPLATES = (
    *BASE,
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved", coverage=1.0),
)

#: Anchors of a template: its rarest words. Words an alignment may be off by (an edit inside the template).
ANCHORS, SLACK = 3, 2

#: Bytes that stand in words (digits, letters in lower case, everything beyond ASCII), the rest become blanks.
_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


@dataclass
class Index:
    """Positional index of the templates, with the words of each weighted by rarity in the corpus."""

    templates: tuple[Template, ...]
    words: list[list[bytes]] = attribute(default_factory=list)
    phrases: list[list[bytes]] = attribute(default_factory=list)
    weights: list[list[float]] = attribute(default_factory=list)
    places: dict[bytes, list[tuple[int, int]]] = attribute(default_factory=dict)
    anchors: dict[bytes, list[tuple[int, int]]] = attribute(default_factory=dict)
    least: list[int] = attribute(default_factory=list)


def vocabulary(templates: tuple[Template, ...]) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in words_of(t.text))


def corpus_frequencies(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows in the table, and for every word of the templates the rows that hold it. Bounded by the templates."""
    wanted = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, dict.fromkeys(wanted, 0)
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0).to_pylist():
                for w in wanted.intersection(words_of(t)):
                    held[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [b"", *held], "n": [rows, *held.values()]}, pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    found = df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in found}
    return counts.pop(b"", 0), counts


def build_index(templates: tuple[Template, ...], rows: int, held: dict[bytes, int]) -> Index:
    rarity = {w: math.log((rows + 1) / (held.get(w, 0) + 1)) + 0.01 for w in vocabulary(templates)}
    index = Index(templates)
    for k, t in enumerate(templates):
        words = words_of(t.text)
        index.words.append(words)
        index.phrases.append(words_of(t.phrase))
        index.weights.append([rarity[w] for w in words])
        for at, w in enumerate(words):
            index.places.setdefault(w, []).append((k, at))
        chosen = range(len(words)) if t.base else sorted(range(len(words)), key=lambda i: (-rarity[words[i]], i))[:ANCHORS]
        index.least.append(len(words) if t.base else min(2, len(words)))
        for at in chosen:
            index.anchors.setdefault(words[at], []).append((k, at))
    return index


def scan(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], dict[str, float]]:
    """Base places as (start, template), and the best coverage by label."""
    base: list[tuple[int, int]] = []
    labels: dict[str, float] = {}
    if index.anchors.keys().isdisjoint(words):
        return base, labels
    votes: dict[tuple[int, int], set[int]] = {}
    for at, w in enumerate(words):
        for k, place in index.anchors.get(w, ()):
            votes.setdefault((k, at - place), set()).add(place)
    for (k, start), seen in sorted(votes.items()):
        t = index.templates[k]
        if t.base:
            if len(seen) == index.least[k]:
                base.append((start, k))
                labels[t.label] = 1.0
            continue
        near = seen.union(*(votes.get((k, start + d), ()) for d in range(-SLACK, SLACK + 1)))
        if len(near) < index.least[k]:
            continue
        size, phrase = len(index.words[k]), index.phrases[k]
        first, end = max(0, start - SLACK), min(len(words), start + size + SLACK)
        if not any(words[i:i + len(phrase)] == phrase for i in range(first, end - len(phrase) + 1)):
            continue
        found = sum(
            x for i, (w, x) in enumerate(zip(index.words[k], index.weights[k]))
            if w in words[max(0, start + i - SLACK):max(0, start + i + SLACK + 1)]
        )
        score = min(1.0, found / sum(index.weights[k]))
        if score >= t.coverage:
            labels[t.label] = max(labels.get(t.label, 0.0), score)
    return base, labels


def scan_licenses(
    df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Add word count, base places and labels, all labels, and the best coverage (0 without a licence)."""
    index = build_index(templates, *corpus_frequencies(df, templates, text))

    def start():
        def work(texts):
            out = [[] for _ in range(7)]
            for t in texts:
                words = words_of(t)
                base, labels = scan(words, index)
                starts = [x for x, _ in base]
                row = (
                    len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({index.templates[k].label for _, k in base})), ",".join(sorted(labels)), max(labels.values(), default=0.0),
                )
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return work

    fields = [
        field("n_words", "long"), field("n_base", "long"), field("first_word", "long"), field("last_word", "long"),
        field("base_labels", "string"), field("labels", "string"), field("score", "double"),
    ]
    return append_columns(df, text, fields, start, keep)
