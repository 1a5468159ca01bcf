"""Ordered file locks, guarded publishing and commits of several tables."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quotalens.operators import checks
from quotalens.sources import commits, sinks, tables


def plain_sequence(data: bytes) -> str:
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    out = []
    for k, base in enumerate(tables.BASES):
        h = 0
        for line in lines:
            code = int(hashlib.md5(line).hexdigest()[:13], 16)
            h = (h * base + (code >> 21 if k else code) % tables.PRIME) % tables.PRIME
        out.append(str(h))
    return "-".join(out)


def lock(spark, path):
    return {r.name: r for r in tables.file_fingerprints(spark, str(path), ordered=True).collect()}


@pytest.mark.parametrize("split", ["16m", "1000"])
def test_sequence_hash_equals_plain_one_however_the_file_is_split(spark, tmp_path, split):
    files = {"a": b"".join(b"line %d\n" % (k * k % 977) for k in range(70_000 if split == "16m" else 900)), "b": b"x\r\ny\r\n", "c": b"one", "d": b"\n\n\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = lock(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {n: (r.bytes, r.sequence_hash) for n, r in got.items()} == {n: (len(d), plain_sequence(d)) for n, d in files.items()}


def test_swapped_lines_line_ends_and_last_line_end_are_seen(spark, tmp_path):
    good = [b"first,1", b"second,2", b"third,3", b"third,3"]
    forms = {
        "same": b"\n".join(good) + b"\n", "swapped": b"\n".join([good[1], good[0], *good[2:]]) + b"\n", "crlf": b"\r\n".join(good) + b"\r\n",
        "open": b"\n".join(good), "blank": b"\n".join([*good, b""]) + b"\n", "moved": b"\n".join([good[2], good[0], good[1], good[3]]) + b"\n"}
    (tmp_path / "f").mkdir()
    frozen = None
    for name, data in forms.items():
        (tmp_path / "f" / "data.txt").write_bytes(data)
        seen = tables.file_fingerprints(spark, f"{tmp_path}/f", ordered=True)
        seen = spark.createDataFrame(seen.collect(), seen.schema)
        frozen = frozen or seen
        assert tables.manifest_violations(seen, frozen).count() == (name != "same"), name
    (tmp_path / "f" / "data.txt").write_bytes(forms["swapped"])  # the order-free lock alone doesn't see this
    assert tables.manifest_violations(tables.file_fingerprints(spark, f"{tmp_path}/f"), frozen).count() == 0


# --- Publishing -----------------------------------------------------------------------------------------------------

def people(spark, bad=None):
    rows = [("t", k, k % 2, k / 10, k % 11) for k in range(50)]
    if bad:
        rows[7] = tuple(bad.get(c, v) for c, v in zip(("target", "pos", "y", "score", "entry"), rows[7]))
    return spark.createDataFrame(rows, "target string, pos long, y int, score double, entry int").repartition(4)


def all_guards(df):
    return checks.guards(df, ["y"], False, "entry", "score")


def test_guards_pass_and_everything_is_counted_in_one_job(spark, tmp_path):
    df = people(spark)
    lock_ = tables.fingerprint(df, df.columns).first().asDict()
    tracker, group = spark.sparkContext.statusTracker(), "guarded-write"
    spark.sparkContext.setJobGroup(group, group)
    seen = sinks.publish(df, f"{tmp_path}/ok", 50, lock_, guards=all_guards(df))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {k: seen[k] for k in lock_} == lock_ and not any(v for k, v in seen.items() if " is " in k)
    # AQE runs the repartition as a job of its own; there is no scan of what was written.
    assert len(tracker.getJobIdsForGroup(group)) <= 2
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 50


@pytest.mark.parametrize("bad, name", [
    ({"y": 2}, "y is not binary"), ({"y": None}, "y is not binary"), ({"entry": 11}, "entry is outside 0..10"), ({"score": float("nan")}, "score is not finite"),
    ({"score": None}, "score is not finite"), ({"score": float("inf")}, "score is not finite")])
def test_a_broken_guard_leaves_nothing(spark, tmp_path, bad, name):
    df = people(spark, bad)
    with pytest.raises(ValueError, match=f"{name.replace('..', '.*')} 1"):
        sinks.publish(df, f"{tmp_path}/bad", guards=all_guards(df))
    assert list(Path(tmp_path).iterdir()) == []


def test_guards_follow_the_checks(spark):
    df = spark.createDataFrame([("1", 3.5), ("x", -1.0), (None, None), ("0", float("nan"))], "y string, entry double")
    counts = df.agg(*[g.alias(n) for n, g in checks.guards(df, ["y"], False, "entry").items()]).first().asDict()
    assert counts == {"y is not binary": 2, "entry is outside 0..10": 1, "entry is fractional": 1}
    assert df.agg(checks.guards(df, ["y"], True)["y is not binary"]).first()[0] == 0


def test_wrong_rows_or_content_leave_nothing(spark, tmp_path):
    df = people(spark)
    other = tables.fingerprint(df.limit(3), df.columns).first().asDict()
    with pytest.raises(ValueError, match="observed 50 rows where 51 were due"):
        sinks.publish(df, f"{tmp_path}/bad", 51)
    with pytest.raises(ValueError, match="not the locked fingerprint"):
        sinks.publish(df, f"{tmp_path}/bad", None, other)
    assert list(Path(tmp_path).iterdir()) == []
    assert sinks.publish(df.limit(0), f"{tmp_path}/none")["rows"] == 0


# --- Commits ----------------------------------------------------------------------------------------------------------

def test_tables_appear_together(spark, tmp_path):
    root = f"{tmp_path}/r"
    with pytest.raises(FileNotFoundError):
        commits.read_table(spark, root, "a")
    one, two = spark.range(3), spark.range(5)
    assert commits.commit_tables({"a": one, "b": two}, root, status="PASS") == 1
    assert commits.commit_tables({"a": two}, root) == 2
    assert commits.versions(spark, root) == [1, 2]
    assert commits.read_table(spark, root, "a").count() == 5 and commits.read_table(spark, root, "a", 1).count() == 3
    with pytest.raises(FileNotFoundError):  # the last version as a whole is what counts
        commits.read_table(spark, root, "b")
    assert commits.read_table(spark, root, "b", 1).count() == 5


def test_an_interrupted_run_is_not_seen(spark, tmp_path):
    root = f"{tmp_path}/r"
    commits.commit_tables({"a": spark.range(3), "b": spark.range(4)}, root)
    fails = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        commits.commit_tables({"a": spark.range(30), "b": fails}, root)
    assert commits.versions(spark, root) == [1] and commits.read_table(spark, root, "a").count() == 3
    Path(f"{root}/manifests/000000000002.json").write_text('{"version": 2, "fol')  # a half-written manifest
    Path(f"{root}/manifests/000000000003.json").write_text("")
    assert commits.versions(spark, root) == [1] and commits.read_table(spark, root, "b").count() == 4
    assert commits.commit_tables({"a": spark.range(6)}, root) == 4
    assert commits.read_table(spark, root, "a").count() == 6


def test_two_writers_get_two_versions(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/r"
    commits.commit_tables({"a": spark.range(1)}, root)
    plain = commits._numbers
    monkeypatch.setattr(commits, "_numbers", lambda s, r: plain(s, r)[:-1])  # the other one committed after the look
    assert commits.commit_tables({"a": spark.range(2)}, root) == 2
    monkeypatch.setattr(commits, "_numbers", plain)
    assert commits.read_table(spark, root, "a", 1).count() == 1 and commits.read_table(spark, root, "a").count() == 2
