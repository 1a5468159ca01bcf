"""Result tables, score exports, run records and checked publishing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotalens.functions.cleaning import clean, field_texts, is_missing
from quotalens.functions.fields import DERIVED, FIELDS
from quotalens.sources.tables import fingerprint_measures


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def write_results(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each result table under its name; CSV tables carry a header."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(f"{folder}/{name}")
        else:
            writer.parquet(f"{folder}/{name}")


def export_scores(population: DataFrame, folder: str) -> None:
    """Label, score and entry per record, one directory per target."""
    population.select("target", "pos", "y", "score", "entry").write.mode("errorifexists").partitionBy("target").parquet(folder)


def publish(
    df: DataFrame, path: str, expected_rows: int | None = None, expected_fingerprint: Mapping[str, object] | None = None,
    columns: Sequence[str] = (), guards: Mapping[str, Column] | None = None,
) -> dict[str, object]:
    """All or nothing: stage next to the destination, judge what was counted during the write, then rename.

    Rows, fingerprint and ``guards`` (aggregates that count violations, see :func:`~quotalens.operators.checks.guards`) are
    observed while the table is staged, so nothing is scanned twice. An existing destination is refused and stays untouched.
    A failed check leaves no destination behind. Returns everything that was counted.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    watch = Observation()
    named = [count.alias(name) for name, count in (guards or {}).items()]
    df.observe(watch, *fingerprint_measures(columns or df.columns), *named).write.parquet(staged)
    seen = watch.get
    broken = {name: seen[name] for name in guards or {} if seen[name]}
    problem = None
    if expected_rows is not None and seen["rows"] != expected_rows:
        problem = f"the write observed {seen['rows']} rows where {expected_rows} were due"
    elif expected_fingerprint is not None and any(seen[k] != v for k, v in expected_fingerprint.items()):
        problem = "the written content has not the locked fingerprint"
    elif broken:
        problem = "guards count violations: " + ", ".join(f"{name} {n}" for name, n in broken.items())
    fs, source = filesystem(spark, staged)
    if problem is None and exists(spark, path):
        problem = f"another writer took {path} meanwhile"
    if problem is not None:
        fs.delete(source, True)
        raise ValueError(f"{problem}; the destination was left alone")
    if not fs.rename(source, filesystem(spark, path)[1]):
        raise OSError(f"could not publish to {path}")
    return seen


def field_table(spark: SparkSession) -> DataFrame:
    """The record layout as a table: field, coordinates, kind, role and code sets."""
    rows = [
        (i, f.name, f.start, f.end, f.kind, f.role, list(f.missing), list(f.allowed), f.low, f.high, f.decimals)
        for i, f in enumerate(FIELDS, start=1)
    ]
    schema = (
        "field_no int, field string, start_col int, end_col int, kind string, role string, missing array<string>, "
        "allowed array<string>, low double, high double, decimals int"
    )
    return spark.createDataFrame(rows, schema)


def derived_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DERIVED.items()), "column string, definition string")


def write_schema(spark: SparkSession, folder: str) -> None:
    """Layout and derived-column definitions as JSON lines."""
    field_table(spark).coalesce(1).write.mode("errorifexists").json(f"{folder}/fields")
    derived_table(spark).coalesce(1).write.mode("errorifexists").json(f"{folder}/derived")


def write_run_record(spark: SparkSession, folder: str, **facts: object) -> None:
    """Parameters, row counts and status of a run as one JSON document."""
    text = json.dumps(facts, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def field_profile(parsed: DataFrame) -> DataFrame:
    """What the data shows per field of the layout: known, missing and rejected values, in one pass.

    Records with a whole-record fault are left out; their fields were not judged.
    """
    parsed = parsed.where(~F.array_contains(F.col("faults.field"), "record"))
    bad = {f.name: F.array_contains(F.col("faults.field"), f.name) for f in FIELDS}
    counts = []
    for f in FIELDS:
        counts += [F.count(f.name).alias(f"known_{f.name}"), F.count_if(bad[f.name]).alias(f"bad_{f.name}")]
    wide = parsed.agg(F.count(F.lit(1)).alias("rows"), *counts)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("field_no"), F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), F.lit(f.role).alias("role"),
            F.col(f"known_{f.name}").alias("known_n"), F.col(f"bad_{f.name}").alias("rejected_n"),
            (F.col("rows") - F.col(f"known_{f.name}") - F.col(f"bad_{f.name}")).alias("missing_n"),
        )
        for i, f in enumerate(FIELDS, start=1)
    ])
    return wide.select(F.inline(rows))


def line_profile(lines: DataFrame, year: int, line: str = "value") -> DataFrame:
    """:func:`field_profile` of strictly parsed lines, judging each distinct text of a field once instead of every value."""
    texts = field_texts(lines, year, line)
    known = F.coalesce(*[F.when(F.col("field_no") == i, clean(f, F.col("text")).isNotNull()) for i, f in enumerate(FIELDS, start=1)])
    missing = F.coalesce(*[F.when(F.col("field_no") == i, is_missing(f, F.col("text"))) for i, f in enumerate(FIELDS, start=1)])
    judged = texts.select("field_no", "n", known.alias("known"), missing.alias("missing")).groupBy("field_no").agg(*[
        F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name) for name, when in (
            ("known_n", F.col("known")), ("rejected_n", ~F.col("known") & ~F.col("missing")), ("missing_n", ~F.col("known") & F.col("missing")))
    ])
    layout = field_table(lines.sparkSession).select("field_no", "field", "kind", "role")
    return layout.join(judged, "field_no", "left").select(
        "field_no", "field", "kind", "role", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("known_n", "rejected_n", "missing_n")])
