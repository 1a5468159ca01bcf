"""Scored populations bound to the test tables: (target, pos, y, score, entry)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.functions.fields import FIELDS, RECORD_LENGTH, Field
from quotalens.operators.cohorts import by_target
from quotalens.operators.features import FeatureParameters
from quotalens.operators.grid import Availability
from quotalens.session import shared_folder, shuffle_width
from quotalens.sources.fixed_width import read_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as records: entry is the month, 11 counts as none and 12 as unknown; two binary labels."""
    month = F.month("o_orderdate")
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"),
        F.col("o_totalprice").alias("fine_score"),
        F.when(month == 11, 0).when(month == 12, None).otherwise(month).cast("int").alias("entry"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"),
        F.when(F.col("o_orderstatus") != "P", urgent).alias("is_urgent"),
    )


def orders_population(spark: SparkSession, folder: str, score: str = "score") -> DataFrame:
    """Two targets over the orders, with a heavily tied score; unknown labels are left out per target."""
    records = order_records(spark, folder).withColumn("score", F.col(score))
    return by_target(records, ["is_f", "is_urgent"], ["pos", "score", "entry"])


def events_population(spark: SparkSession, folder: str, calibration: bool | None = None) -> DataFrame:
    """Purchases among events; the first 20 days are the calibration period."""
    part = F.col("user_id") % 12
    early = F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")
    events = table(spark, folder, "events")
    if calibration is not None:
        events = events.where(early if calibration else ~early)
    return events.select(
        F.lit("purchase").alias("target"),
        F.col("event_id").alias("pos"),
        F.col("value").alias("score"),
        F.when(part < 11, part).cast("int").alias("entry"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        early.alias("calibration"),
        (F.col("user_id") % 5).alias("replicate"),
    )


def documents_population(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score in (0, 1): two targets, quality and toxic."""
    part = F.col("doc_id") % 12
    records = table(spark, folder, "documents").select("doc_id", "n_chars").join(
        table(spark, folder, "labels"), "doc_id"
    ).select(
        F.col("doc_id").alias("pos"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score"),
        F.when(part < 11, part).cast("int").alias("entry"),
        "quality", "toxic",
    )
    return by_target(records, ["quality", "toxic"], ["pos", "score", "entry"])


# Fixed-width lines made from orders. Field number i is good, missing or faulty by rule, so that the expected table can
# be computed from the order's key k, customer c and rounded price p without parsing anything.

FAULTY_EVERY, MISSING_EVERY = 211, 13
CUT_EVERY, ODD_EVERY = 101, 103


def field_code(i: int) -> str:
    """SQL for the number behind field ``i``, from one of the order's columns; the same text works in any engine."""
    return f"({'kcp'[i % 3]} * {2 * i + 7} + {3 * i * i})"


#: SQL for the columns behind the fields.
LINE_COLUMNS = "o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p"


def field_text(i: int, f: Field) -> tuple[str, str, str]:
    """SQL for the good text, and the missing and faulty texts of field ``i``."""
    code = field_code(i)
    missing = f.missing[0] if f.missing else ""
    if f.name == "birth_year":
        return "'2022'", "2022", "2021"
    if f.kind == "boolean":
        return f"CASE WHEN {code} % 2 = 0 THEN 'Y' ELSE 'N' END", missing, "X"
    if f.kind == "category":
        cases = " ".join(f"WHEN {j} THEN '{a}'" for j, a in enumerate(f.allowed))
        return f"CASE {code} % {len(f.allowed)} {cases} END", missing, "32" if f.name == "mother_race" else "Z"
    if f.kind == "float":
        tenths = f"({round(f.low * 10)} + {code} % {round((f.high - f.low) * 10) + 1})"
        whole = f"cast(({tenths} - {tenths} % 10) / 10 AS bigint)"
        return f"concat(cast({whole} AS varchar(9)), '.', cast({tenths} % 10 AS varchar(9)))", missing, "70.0"
    above = str(int(f.high) + 1)
    faulty = "x" if above in f.missing or len(above) > f.width else above
    number = f"cast({int(f.low)} + {code} % {int(f.high - f.low) + 1} AS varchar(9))"
    return f"lpad({number}, {f.width}, '0')", missing, faulty


def field_sql(i: int, f: Field) -> str:
    """SQL for the raw text of field ``i``."""
    good, missing, faulty = field_text(i, f)
    return (
        f"CASE WHEN k % {FAULTY_EVERY} = {i} THEN '{faulty}' "
        f"WHEN k % {MISSING_EVERY} = {i % MISSING_EVERY} THEN '{missing}' ELSE {good} END"
    )


#: Lines of a compressed file, which one task reads.
LINES_PER_FILE = 250_000

#: Columns that no field uses; the order key stands there so that a line can be traced.
KEY_START, KEY_WIDTH = 15, 12


def rendered_lines(spark: SparkSession, folder: str, lenient: bool = False) -> DataFrame:
    """One fixed-width line per order, written as text files with carriage returns and read back: ``pos``, ``value``.

    The files are compressed: a line is 1,330 characters, most of them blank, so plain ones are the larger part of all that is written.
    Some lines are cut short, not ASCII or (leniently) blank.
    """
    keys = table(spark, folder, "orders").selectExpr(*LINE_COLUMNS.split(", "))
    raw = keys.repartition(shuffle_width(keys), "k").select(
        "k", *[F.rpad(F.expr(field_sql(i, f)), f.width, " ").alias(f.name) for i, f in enumerate(FIELDS)]
    )
    places = sorted([(f.start, f.width, F.col(f.name)) for f in FIELDS] + [(KEY_START, KEY_WIDTH, F.lpad(F.col("k").cast("string"), KEY_WIDTH, "0"))],
                    key=lambda place: place[0])
    pieces, at = [], 1
    for start, width, text in places:
        pieces += [F.lit(" " * (start - at)), text]
        at = start + width
    line = F.concat(*pieces, F.lit(" " * (RECORD_LENGTH + 1 - at)))
    cut, odd = F.col("k") % CUT_EVERY == 0, F.col("k") % ODD_EVERY == 0
    if lenient:
        rest = F.when(odd, 0).when(cut, 300).otherwise(RECORD_LENGTH)
        value = F.substring(line, F.lit(1), rest)
    else:
        value = F.overlay(F.substring(line, F.lit(1), F.when(cut, RECORD_LENGTH - 1).otherwise(RECORD_LENGTH)),
                          F.when(odd & ~cut, "é").otherwise(" "), 1)
    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    raw.select(F.concat(value, F.lit("\r")).alias("value")).write.option("maxRecordsPerFile", LINES_PER_FILE).text(path, compression="gzip")
    key = F.substring("value", KEY_START, KEY_WIDTH).try_cast("bigint")
    return read_lines(spark, path).select(key.alias("pos"), "value")


def feature_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer features, some of them unknown, a numeric category and a label."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    month = F.month("o_orderdate")
    return table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("is_f").alias("target"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price"),
        F.when(month < 12, month).cast("double").alias("month"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).cast("double").alias("nation"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.when(month == 11, 0).when(month == 12, None).otherwise(month).cast("int").alias("entry"),
    )


#: Fixed parameters for the frozen transform of the feature records.
FROZEN = FeatureParameters(
    numeric=("acctbal", "price", "month"), medians=(4500.0, 250.0, 6.0), means=(4400.0, 251.5, 6.25), scales=(2750.0, 143.5, 3.125),
    category="nation", mode=7.0, categories=tuple(float(v) for v in range(20)),
)


#: Availability attributes of an event: name -> (SQL, number of its values).
GRID_ATTRIBUTES = {"hour_of_day": ("hour(ts)", 24), "minute_of_hour": ("minute(ts)", 60), "user_group": ("user_id % 10", 10)}


def grid_population(spark: SparkSession, folder: str, calibration: bool) -> DataFrame:
    """Events by replicate (user group) and score quality, with the attributes that make them available."""
    early = F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")
    return table(spark, folder, "events").where(early if calibration else ~early).select(
        (F.col("user_id") % 5).alias("replicate"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").cast("int").alias("y"),
        *[F.expr(sql).alias(name) for name, (sql, _) in GRID_ATTRIBUTES.items()],
        F.inline(F.array(
            F.struct(F.lit("good").alias("model_quality"), F.col("value").alias("score")),
            F.struct(F.lit("weak").alias("model_quality"), F.floor(F.col("value") / 40).cast("double").alias("score")),
        )),
    )


GRID_BY = ("replicate", "model_quality")
GRID_LABELS = ("availability_target_fraction", "availability_relation")
GRID_FRACTIONS = (0.05, 0.1, 0.2)
GRID_SHARES = (0.5, 0.7)


def grid_sets() -> dict[str, Availability]:
    """Events are available whose attribute is among the first values, as many as the share says."""
    return {
        f"{share}|{name}": Availability(dict(zip(GRID_LABELS, (share, name))), F.col(name) < round(share * values))
        for share in GRID_SHARES for name, (_, values) in GRID_ATTRIBUTES.items()}
