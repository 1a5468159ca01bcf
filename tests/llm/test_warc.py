"""WARC archives: what is written is read back, and what damage leaves is recovered."""

import gzip
import hashlib
import os
import random
from collections import Counter
from pathlib import Path

import pytest

from helpers import words
from quotalens.llm import warc

PAGES = "page_id long, url string, html string"


def archives(folder):
    return sorted(p for p in Path(folder).iterdir() if p.name.startswith("part-") and p.stat().st_size)


def page_rows():
    long = words(1, 400)
    same = [(k, f"http://h/{k}", long) for k in range(30, 60)]
    return same + [
        (1, "http://a/ b\n", "é" * 499 + "xx"), (2, None, "é" * 499 + "xx"), (3, "u", None), (3, "u", ""), (4, "u", "x" * 999), (5, "u", "x" * 999),
        (6, "u", long + "!"), (6, "u", long + "!"), (6, "v", long + "!"), (None, "n", "z" * 2000), (None, "n", "z" * 2000), (7, "q", "WARC/1.1\r\n\r\n" * 200),
        (8, "big", words(8, 60_000)), (-9, "n", "\r\n\r\n"), (10, "c", "z" * 1000), (11, "c", "z" * 1000)]


def expected(rows):
    best: dict = {}
    for key, _, html in rows:
        best.setdefault(html or "", []).append(key)
    out = []
    for html, keys in best.items():
        data = html.encode()
        keys.sort(key=lambda k: (k is not None, k or 0), reverse=True)
        for place, key in enumerate(keys):
            again = len(data) >= 1000 and place > 0
            out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keys[0] if again else None))
    return Counter(out)


@pytest.mark.parametrize("compress", [True, False])
def test_rows_come_back(spark, folder, compress):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS row", "'x' AS digest", "2 AS size", "'y' AS payload", "true AS revisit")
    warc.write_archives(df.repartition(5), f"{folder}/a", compress=compress)
    found = warc.read_archives(spark, f"{folder}/a")
    assert warc.gaps(found).count() == 0
    got = warc.records(found).withColumn("key", warc.key_of("record_id")).withColumn("response", warc.key_of("refers_to")).collect()
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.response) for r in got) == expected(rows)
    texts = {(k, h or "") for k, _, h in rows}
    assert all((r.key, r.payload.decode()) in texts for r in got if r.record_type == "response")
    assert all(r.payload == b"" for r in got if r.record_type == "revisit")
    assert {r.uri for r in got if r.key in (1, 2, 8)} == {"http%3A%2F%2Fa%2F+b%0A", None, "big"}
    bare = warc.records(warc.read_archives(spark, f"{folder}/a", payloads=False))
    assert bare.filter("payload IS NOT NULL").count() == 0 and bare.count() == len(rows)


def test_members_are_plain_gzip(spark, folder):
    warc.write_archives(spark.createDataFrame(page_rows(), PAGES), f"{folder}/a")
    warc.write_archives(spark.createDataFrame(page_rows(), PAGES), f"{folder}/b", compress=False)
    one = sorted(gzip.decompress(p.read_bytes()).count(b"WARC-Type") for p in archives(f"{folder}/a"))
    two = sorted(p.read_bytes().count(b"WARC-Type") for p in archives(f"{folder}/b"))
    assert one == two and sum(one) == len(page_rows())


def test_archive_size_is_respected(spark, folder):
    rows = [(k, "u", words(k, 200)) for k in range(400)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), f"{folder}/a", archive_bytes=20_000)
    sizes = [p.stat().st_size for p in archives(f"{folder}/a")]
    assert len(sizes) > 15 and max(sizes) < 60_000


def test_empty_table(spark, folder):
    warc.write_archives(spark.createDataFrame([], PAGES), f"{folder}/a")
    assert warc.read_archives(spark, f"{folder}/a").count() == 0


# --- Damage -------------------------------------------------------------------------------------------------------

def record(key, payload, compress, quoted=b""):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    sha = hashlib.sha1(body).hexdigest().encode()
    out = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:%d>\r\nWARC-Block-Digest: sha1:%s\r\n%sContent-Type: application/http\r\n"
           b"Content-Length: %d\r\n\r\n" % (key, sha, quoted, len(body))) + body + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


def whole(data):
    """Keys found and gaps; every byte belongs to a record or to a gap."""
    keys, gaps, at = [], [], 0
    for place, size, inner, part, found, reason, _ in warc.salvage(data):
        if inner == 0:
            assert place == at
            at = place + size
        if found:
            keys.append(int(found["record_id"][14:-1]))
        else:
            gaps.append((place, size, inner, part, reason))
    assert at == len(data)
    return keys, gaps


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(25))
def test_undamaged_records_survive(compress, seed):
    rng = random.Random(seed)
    parts = [record(k, rng.randbytes(rng.choice([0, 30, 3000, 20_000])) + words(k, 20).encode(), compress) for k in range(30)]
    edges = [0]
    for p in parts:
        edges.append(edges[-1] + len(p))
    data = bytearray(b"".join(parts))
    hit = set()
    for _ in range(rng.randint(1, 4)):  # bytes are changed in place, so that records keep their places
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.choice([1, 5, 500, 9000]))
        data[a:b] = bytes(x ^ rng.randrange(1, 256) for x in data[a:b])
        hit |= {k for k in range(30) if edges[k] < b and a < edges[k + 1]}
    keys, gaps = whole(bytes(data))
    # A few bytes of a gzip header (time, system) are under no check, so a hit record may pass as well.
    assert set(keys) >= set(range(30)) - hit and keys == sorted(set(keys))
    assert bool(gaps) == (len(keys) < 30)
    starts = {edges[k] for k in range(30)}
    assert all(g[0] in starts for g in gaps)


@pytest.mark.parametrize("compress", [True, False])
def test_inserted_and_lost_bytes(compress):
    parts = [record(k, words(k, 80).encode(), compress) for k in range(6)]
    junk = b"junk \x1f\x8b\x08 WARC/1. WARC/1.0\r\n" * 5
    assert whole(junk + b"".join(parts)) == ([0, 1, 2, 3, 4, 5], [(0, len(junk), 0, 0, "version line")])
    keys, gaps = whole(parts[0] + parts[1][:-30] + parts[2] + junk + parts[3] + parts[4][20:] + parts[5][:40])
    assert keys == [0, 2, 3] and len(gaps) == 3
    keys, gaps = whole(b"".join(parts)[:-1])
    assert keys == [0, 1, 2, 3, 4] and gaps[0][4] in ("truncated member", "truncated record")


@pytest.mark.parametrize("quoted, reason", [
    (b"no colon\r\n", "header line"), (b"WARC-Payload-Digest: sha1:" + b"0" * 40 + b"\r\n", "payload digest"), (b"WARC-Payload-Digest: sha1:!\r\n", "digest"),
    (b"WARC-Type: nothing\r\n", "mandatory header"), (b"Content-Length: -1\r\n", "content length")])
def test_failed_checks_are_named(quoted, reason):
    bad = record(2, b"abc", False, quoted)
    if quoted.startswith(b"Content-Length"):
        bad = bad.replace(b"Content-Type: application/http\r\nContent-Length: ", b"Content-Type: application/http\r\nX: ")
    data = record(1, b"abc", False) + bad + record(3, b"d", False)
    keys, gaps = whole(data)
    assert keys == [1, 3] and [g[4] for g in gaps] == [reason] and gaps[0][1] == len(bad)
    keys, gaps = whole(gzip.compress(record(1, b"a", False) + bad + record(3, b"d", False)))  # several records in one member
    assert keys == [1, 3] and gaps[0][3:] == (len(bad), reason)


def test_base32_digests_and_folded_headers():
    import base64

    body = b"abc"
    digest = base64.b32encode(hashlib.sha1(body).digest())
    data = (b"WARC/1.1\r\nwarc-type: resource\r\nWARC-Record-ID:\r\n <urn:x-record:5>\r\nWARC-Payload-Digest: SHA1:" + digest
            + b"\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (_, _, _, _, found, _, _), = warc.salvage(data)
    assert found["record_id"] == "<urn:x-record:5>" and found["payload_digest"] == hashlib.sha1(body).hexdigest() and found["payload_bytes"] == 3


def test_many_false_starts_end_soon():
    bad = b"WARC/1.0\r\n" * 60_000 + b"\x1f\x8b\x08\0" * 60_000
    keys, gaps = whole(bad + record(9, b"x", True))
    assert keys == [9] and gaps[0][1] == len(bad)


def test_damaged_archives_are_read_by_spark(spark, folder):
    os.makedirs(f"{folder}/d")
    for n in range(3):
        parts = [record(10 * n + k, words(k, 90).encode(), n != 1) for k in range(5)]
        data = bytearray(b"".join(parts))
        data[len(parts[0]) + 200] ^= 0xFF
        Path(f"{folder}/d/part-{n}.warc").write_bytes(data)
    found = warc.read_archives(spark, f"{folder}/d")
    assert {r.k for r in warc.records(found).select(warc.key_of("record_id").alias("k")).collect()} == {10 * n + k for n in range(3) for k in (0, 2, 3, 4)}
    assert sorted(r.size > 0 and Path(r.file).name for r in warc.gaps(found).collect()) == [f"part-{n}.warc" for n in range(3)]
