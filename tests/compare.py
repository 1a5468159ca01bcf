"""Run a registered query and its SQL side by side and report the first difference."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

_SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when names, types and the multiset of rows agree exactly."""
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = sorted(spark_df.columns)
    if names != sorted(kinds):
        return f"columns differ: {sorted(set(names) ^ set(kinds))}"
    wrong = {c: (t, kinds[c]) for c, t in spark_df.dtypes if _SAME.get(t, t) != kinds[c]}
    if wrong:
        return f"types differ: {wrong}"
    quoted = ", ".join(f'"{c}"' for c in names)
    theirs = Counter(tuple(_plain(v) for v in r) for r in con.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
    ours = Counter(tuple(_plain(r[c]) for c in names) for r in spark_df.collect())
    if ours == theirs:
        return None
    extra, lacking = list((ours - theirs).items())[:1], list((theirs - ours).items())[:1]
    spots = [c for c, a, b in zip(names, extra[0][0], lacking[0][0]) if a != b] if extra and lacking else []
    return f"rows {sum(ours.values())} / {sum(theirs.values())}; at {spots}; ours {extra}; theirs {lacking}"
