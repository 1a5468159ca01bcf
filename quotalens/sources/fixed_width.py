"""Fixed-width text files as lines with a stable, orderable position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``pos`` and ``value``.

    Only a line feed ends a record, so a stray carriage return cannot split one. ``pos`` is a struct that orders
    the records as they stand in the files: file, split start, row within the task.
    """
    return spark.read.text(path, lineSep="\n").select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("pos"),
        "value",
    )
