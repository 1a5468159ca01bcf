"""CSV tables with projection and locks, threshold tables, content fingerprints and checksum manifests."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotalens.names import ALL, FIXED_THRESHOLD


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV source, read from its first line only."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str], types: dict[str, str] | None = None, expected_rows: int | None = None
) -> DataFrame:
    """The named columns of a CSV source; missing columns or an unexpected row count fail."""
    present = header(spark, path)
    absent = sorted(set(columns) - set(present))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    kinds = types or {}
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(kinds.get(c, "string"))) for c in present])
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).select(*columns)
    if expected_rows is not None:
        seen = df.count()
        if seen != expected_rows:
            raise ValueError(f"row count {seen}, expected {expected_rows}")
    return df


_THRESHOLD_TYPES = {
    "target": "string", "nominal_fraction": "double", "threshold": "double", "source_year": "int",
    "threshold_source_year": "int", "comparator": "string",
}


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """A thresholds CSV with full double precision; the three required columns and whatever provenance it has."""
    present = header(spark, path)
    absent = {"target", "nominal_fraction", "threshold"} - set(present)
    if absent:
        raise ValueError(f"thresholds need columns {sorted(absent)}")
    return read_csv(spark, path, [c for c in _THRESHOLD_TYPES if c in present], _THRESHOLD_TYPES)


def threshold_violations(
    thresholds: DataFrame, targets: Sequence[str], fractions: Sequence[float], year: int = 2022
) -> DataFrame:
    """Everything wrong with a thresholds table as rows (target, nominal_fraction, problem). Empty means usable."""
    spark = thresholds.sparkSession
    keys = ["target", "nominal_fraction"]
    grid = spark.createDataFrame([(t, float(q)) for t in targets for q in fractions], "target string, nominal_fraction double")
    counted = thresholds.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    problems = [
        grid.join(counted, keys, "left_anti").withColumn("problem", F.lit("missing")),
        counted.join(grid, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem")),
        counted.where("rows > 1").select(*keys, F.lit("duplicate").alias("problem")),
    ]
    t = F.col("threshold")
    rules = {"not a probability": t.isNull() | F.isnan(t) | (t < 0) | (t > 1)}
    for column in ("source_year", "threshold_source_year"):
        if column in thresholds.columns:
            rules[f"{column} is not {year}"] = ~F.col(column).eqNullSafe(F.lit(year))
    if "comparator" in thresholds.columns:
        rules["comparator is not >="] = ~F.col("comparator").eqNullSafe(F.lit(">="))
    faults = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    problems.append(thresholds.select(*keys, F.explode(faults).alias("problem")))
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out


def cutoffs_from_protocols(protocols: DataFrame, fraction: float = 0.10) -> DataFrame:
    """Threshold rows held in a protocol table: fixed-threshold protocol, whole population, one share."""
    near = F.abs(F.col("nominal_fraction") - F.lit(fraction)) <= F.lit(1e-8 + 1e-5 * fraction)
    return protocols.where(
        (F.col("protocol") == FIXED_THRESHOLD) & near & (F.col("availability_scenario") == ALL)
    ).select("target", "nominal_fraction", "threshold")


def binding_violations(supplied: DataFrame, expected: DataFrame) -> DataFrame:
    """Cutoffs that do not equal the score model's own, bit for bit; empty means bound."""
    keys = ["target", "nominal_fraction"]
    both = supplied.select(*keys, F.col("threshold").alias("supplied")).join(
        expected.select(*keys, F.col("threshold").alias("expected")), keys, "full_outer"
    )
    return both.where(~F.col("supplied").eqNullSafe(F.col("expected")))


def fingerprint_measures(columns: Sequence[str]) -> list[Column]:
    """Aggregates of an order-free content fingerprint: row count, xor and sum of 52-bit row hashes.

    The xor alone would miss rows that occur twice; the sum sees them. NULL and the empty text differ.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    code = _code(text)
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(code).alias("xor_hash"), F.sum(code.cast("decimal(20,0)")).cast("string").alias("sum_hash")]


def _code(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fingerprint of a table as one row."""
    return df.agg(*fingerprint_measures(columns))


#: Modulus and bases of the sequence hash.
PRIME, BASES = (1 << 31) - 1, (1_000_003, 1_592_594_996)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo ``PRIME``."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[:n]


def _residue(code: np.ndarray, k: int) -> np.ndarray:
    """A number below ``PRIME`` for each line; the two bases use different bits of its hash."""
    return (code if k == 0 else code >> 21) % PRIME


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch of lines of one file block: its number of lines, and per base its hash and the power that moves a hash past it."""
    tables = [_powers(b, 1 << 16) for b in BASES]
    names = ("name", "bytes", "block", "part", "lines", "h0", "p0", "h1", "p1")
    part = 0
    for batch in batches:
        start = batch.column(2).to_numpy()
        code = batch.column(3).to_numpy()
        name = batch.column(0).dictionary_encode()
        mark = np.stack([name.indices.to_numpy(), start])
        edge = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        rows = []
        for a, b in zip(edge[:-1], edge[1:]):
            for at in range(a, b, 1 << 16):
                own = code[at:min(b, at + (1 << 16))]
                hashes = [int((_residue(own, k) * table[:len(own)][::-1] % PRIME).sum() % PRIME) for k, table in enumerate(tables)]
                powers = [pow(base, len(own), PRIME) for base in BASES]
                rows.append((name.dictionary[int(mark[0, at])].as_py(), batch.column(1)[at].as_py(), int(start[at]), part, len(own),
                             hashes[0], powers[0], hashes[1], powers[1]))
                part += 1
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def file_fingerprints(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Content fingerprint per text file of any size: ``name`` (path below ``path``), line count, xor and sum of line hashes.

    The files are read as splittable text, so a large one is the work of many tasks. ``ordered`` adds a byte-true lock:
    ``bytes`` and ``sequence_hash``, which sees the order of lines. Each stretch of lines gives a polynomial hash and its
    length; these combine in the order of file blocks, to the same hash however the file is split. Lines end at line
    feeds, so another line end changes the lines, and a missing last one the bytes.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(//[^/]*)?", ""))
    name = F.when(full == root, F.element_at(F.split(full, "/"), -1)).otherwise(F.substr(full, F.lit(len(root) + 2)))
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).select(
        name.alias("name"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"), _code(F.col("value")).alias("code"))
    plain = lines.groupBy("name").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("code").alias("xor_hash"),
        F.sum(F.col("code").cast("decimal(20,0)")).cast("string").alias("sum_hash"))
    if not ordered:
        return plain
    parts = lines.mapInArrow(_sequences, "name string, bytes long, block long, part long, lines long, h0 long, p0 long, h1 long, p1 long")
    stretches = F.sort_array(F.collect_list(F.struct("block", "part", "h0", "p0", "h1", "p1")))

    def fold(k: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("bigint"), lambda h, x: (h * x[f"p{k}"] + x[f"h{k}"]) % PRIME)

    folded = parts.groupBy("name").agg(F.first("bytes").alias("bytes"), stretches.alias("parts")).select(
        "name", "bytes", F.concat_ws("-", fold(0).cast("string"), fold(1).cast("string")).alias("sequence_hash"))
    return plain.join(folded, "name")


# Task bodies travel by value, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def manifest_violations(observed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose fingerprint differs from the frozen list in what both hold, or that exist on one side only."""
    mark = F.struct(*[c for c in ("rows", "xor_hash", "sum_hash", "bytes", "sequence_hash") if c in observed.columns and c in manifest.columns])
    both = observed.select("name", mark.alias("observed")).join(manifest.select("name", mark.alias("expected")), "name", "full_outer")
    return both.where(~F.col("observed").eqNullSafe(F.col("expected")))
