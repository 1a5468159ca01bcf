"""Several result tables published together: a folder per version and one manifest that makes it visible.

A version's tables are written into a folder of their own. Then one small manifest is created under the next free number,
and only if no other writer has created it: that single step is the commit. Readers resolve the highest number whose
manifest is whole; folders without one, of runs that were interrupted or refused, and half-written manifests are ignored.
No folder is renamed, so the same holds on object stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotalens.sources.sinks import exists, filesystem

#: Digits of a version in the name of its manifest.
_DIGITS = 12


def _manifest(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/manifests/{version:0{_DIGITS}d}.json"


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    fs, target = filesystem(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as e:
        if fs.exists(target):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _numbers(spark: SparkSession, root: str) -> list[int]:
    folder = f"{root.rstrip('/')}/manifests"
    if not exists(spark, folder):
        return []
    fs, target = filesystem(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())


def _read(spark: SparkSession, root: str, version: int) -> dict | None:
    """A manifest, or nothing if it is not whole."""
    lines = spark.read.text(_manifest(root, version), wholetext=True).take(1)
    try:
        found = json.loads(lines[0]["value"]) if lines else None
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("version") == version and "tables" in found else None


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    return [n for n in _numbers(spark, root) if _read(spark, root, n)]


def commit_tables(tables: Mapping[str, DataFrame], root: str, **facts: object) -> int:
    """Write all tables, then make them visible in one step; returns the version.

    A writer that loses the race for a number takes the next one. Row counts are observed during the writes and kept in
    the manifest together with ``facts``.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"versions/{uuid.uuid4().hex}"
    held = {}
    for name, df in tables.items():
        watch = Observation()
        df.observe(watch, F.count(F.lit(1)).alias("rows")).write.parquet(f"{root.rstrip('/')}/{folder}/{name}")
        held[name] = {"rows": watch.get["rows"], "schema": df.schema.simpleString()}
    version = max(_numbers(spark, root), default=0) + 1
    while True:
        text = json.dumps({"version": version, "folder": folder, "tables": held, "facts": facts}, default=str, sort_keys=True)
        if _put_if_absent(spark, _manifest(root, version), text):
            return version
        version += 1


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a committed version, by default the last one."""
    if version is None:
        version = next((n for n in reversed(_numbers(spark, root)) if _read(spark, root, n)), None)
    found = None if version is None else _read(spark, root, version)
    if found is None or name not in found["tables"]:
        raise FileNotFoundError(f"no committed {name} in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{found['folder']}/{name}")
