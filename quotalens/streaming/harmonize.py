"""Cleaning and threshold selection of records that arrive as files. Row-wise, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.functions.cleaning import accepted as accepted_rows
from quotalens.functions.cleaning import parse_strict, rejects
from quotalens.operators.selection import threshold_select


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of fixed-width files as they land in ``folder``."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(folder)


def harmonized_stream(lines: DataFrame, year: int) -> DataFrame:
    """The harmonized table plus ``faults`` for a stream of lines."""
    return parse_strict(lines, year, keep=())


def selected_stream(scored: DataFrame, threshold: float, eligible: Column | None = None) -> DataFrame:
    """Records of a scored stream that reach a transported threshold."""
    return threshold_select(scored, threshold, F.lit(True) if eligible is None else eligible)


def write_split(parsed: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """Store accepted records and rejects of each batch; returns the started query.

    A batch owns the directory ``batch=<id>``, so one that is run again after a failure replaces itself.
    """
    def store(batch: DataFrame, number: int) -> None:
        accepted_rows(batch).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        rejects(batch, ()).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
