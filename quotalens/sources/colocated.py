"""Tables stored in hash buckets of their join keys, so that joins and aggregations on these keys don't exchange them again.

A bucket is one file, written by the task that the keys were dealt to. What is joined to such a table is dealt by the same keys to
as many partitions; the stored side stays where it is, however often it is read. Keys should be near to unique: rows of one key
stand in one bucket.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.session import ROWS_PER_TASK, colocated_prefix, shared_folder, shuffle_width

#: Most buckets of a table.
MOST_BUCKETS = 20_000


def buckets_for(df: DataFrame, rows: int, rows_per_bucket: int = ROWS_PER_TASK) -> int:
    """A bucket for every ``rows_per_bucket`` rows, at least the session's shuffle partitions, so that no join prefers another width."""
    return max(shuffle_width(df), min(MOST_BUCKETS, math.ceil(rows / rows_per_bucket)))


def colocate(df: DataFrame, keys: Sequence[str], name: str, buckets: int) -> DataFrame:
    """``df`` stored in the shared folder in ``buckets`` buckets of ``keys``. The one exchange of its rows is the one that deals them.

    The table is external: :func:`quotalens.session.run_scope` drops its name and files at the end of a run.
    """
    spark = df.sparkSession
    unique = f"{colocated_prefix(spark)}{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{unique}"
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    dealt.write.option("path", path).bucketBy(buckets, *keys).saveAsTable(unique)
    return spark.table(unique)


def dealt_like(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` dealt as a stored table of ``buckets`` buckets is."""
    return df.repartition(buckets, *[F.col(k) for k in keys])
