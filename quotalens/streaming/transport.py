"""A transported threshold on scores as they arrive: selections, events and workload difference per time window.

State is one row per open window and group, whatever the number of records in it. The watermark closes a window ``late``
after the newest record; a closed window is put out once and its state dropped. Records later than that are left out, as
in any watermarked aggregation. A restart goes on from the checkpoint: offsets, watermark and open windows are kept there,
and the file sink takes each batch exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.functions.numeric import budget, ratio
from quotalens.names import FRACTIONS
from quotalens.operators.ranking import finite_score
from quotalens.session import materialize


def pivoted_thresholds(thresholds: DataFrame, fractions: Sequence[float] = FRACTIONS, by: Sequence[str] = ("target",)) -> DataFrame:
    """One row per group with its thresholds side by side, written down: the static side of the stream's join."""
    wide = thresholds.groupBy(*by).agg(*[
        F.max(F.when(F.col("nominal_fraction") == F.lit(float(q)), F.col("threshold"))).alias(f"t{k}") for k, q in enumerate(fractions)])
    return materialize(wide, "thresholds")


def window_workload(
    scored: DataFrame, thresholds: DataFrame, width: str = "1 day", late: str = "2 days", fractions: Sequence[float] = FRACTIONS,
    by: Sequence[str] = ("target",), time: str = "ts", unique: Sequence[str] | None = None,
) -> DataFrame:
    """Per group, window and share: records, events, selections and how far they are from the nominal workload.

    ``scored``: by, ``time``, ``score``, ``y``, a stream or a table (then every window is put out). Thresholds of a group
    travel as columns, so a record is never multiplied. ``unique`` names a key by which records that arrive twice while
    their window is open count once. A score that is missing or not finite fails the query.
    """
    by = list(by)
    clock = F.col(time)
    if dict(scored.dtypes)[time] == "timestamp_ntz":  # a time without zone is taken as UTC, whatever the session's zone
        clock = F.from_utc_timestamp(clock.cast("timestamp"), F.current_timezone())
    rows = scored.select(*by, *[c for c in unique or () if c not in by], clock.alias("ts"), finite_score().alias("score"), F.col("y").cast("int").alias("y"))
    if scored.isStreaming:
        rows = rows.withWatermark("ts", late)
        if unique:
            rows = rows.dropDuplicatesWithinWatermark([*unique])
    elif unique:
        rows = rows.dropDuplicates([*unique])
    sums = [F.count(F.lit(1)).alias("N_all"), F.sum("y").alias("E_all")]
    for k in range(len(fractions)):
        hit = F.col("score") >= F.col(f"t{k}")
        sums += [F.first(f"t{k}").alias(f"t{k}"), F.count_if(hit).alias(f"s{k}"), F.sum(F.when(hit, F.col("y")).otherwise(0)).alias(f"p{k}")]
    wide = rows.join(pivoted_thresholds(thresholds, fractions, by), by).groupBy(*by, F.window("ts", width)).agg(*sums)
    parts = F.array(*[
        F.struct(F.lit(float(q)).alias("nominal_fraction"), F.col(f"t{k}").alias("threshold"), F.col(f"s{k}").alias("selected_n"), F.col(f"p{k}").alias("TP"))
        for k, q in enumerate(fractions)])
    long = wide.select(*by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "N_all", "E_all", F.inline(parts))
    nominal: Column = budget(F.col("nominal_fraction"), F.col("N_all"))
    return long.where(F.col("threshold").isNotNull()).select(
        *by, "window_start", "window_end", "nominal_fraction", "threshold", "N_all", "E_all", "selected_n", "TP",
        ratio(F.col("selected_n"), F.col("N_all")).alias("selection_rate"), ratio(F.col("TP"), F.col("E_all")).alias("population_event_capture"),
        ratio(F.col("TP"), F.col("selected_n")).alias("precision"), ratio(F.col("E_all"), F.col("N_all")).alias("prevalence"),
        nominal.alias("nominal_selected_n"), (F.col("selected_n") - nominal).alias("workload_difference_n"))


def write_windows(windows: DataFrame, path: str, checkpoint: str):
    """Append closed windows to a folder of Parquet files until what has arrived is used up; returns the started query."""
    return windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()
