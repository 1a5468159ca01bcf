"""A corpus pipeline from raw documents to tokens. Each stage calls one operator of the ``llm`` subpackage.

Every stage takes (spark, docs, folder), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.llm import bpe, decontaminate, language, neardup, secrets
from quotalens.llm.common import materialize, table
from quotalens.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is told with confidence; texts without a letter go."""
    model = language.fit_languages(docs)
    return language.identify(docs.select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def first_of_class(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id."""
    return neardup.keep_first(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, folder, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document stays; the values of secrets in its text are replaced and the length follows."""
    clean = secrets.redact(docs.select(*COLUMNS), vocabulary("byte_bpe_50k.tiktoken"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packed token ids, checked by decoding: one row per document."""
    out = bpe.transcode(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id", "source"], decoded=False)
    return out.select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", first_of_class),
    ("decontamination", without_benchmark),
    ("secrets", hide_secrets),
    ("bpe", tokenize),
]

#: Classifiers, hash sketches and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
