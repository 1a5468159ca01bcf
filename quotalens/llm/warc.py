"""WARC archives: written by Spark's text writer, read back by a salvage reader that goes on after damage.

Writing. Equal payloads of ``LEAST`` bytes or more are written once, as the ``response`` with the largest key; the others
are ``revisit`` records that refer to it. Copies are found by one aggregation over digests, combined before the shuffle;
digests that hold many rows are few, so these are joined by broadcast and the others by shuffle. Records are dealt by a row
number to archives of about ``ARCHIVE_BYTES``, each record a gzip member of its own (or plain), and committed by Spark like
any other table. The text writer puts a separator after each row: the empty line pair that ends a plain record, or a gzip
member without content, which readers of gzip skip.

Reading. An archive is read whole by one task. Each member must inflate to its check sum, each record must have a version
line, well-formed headers, a block of the stated length, the closing line pair and the stated digests. Where a check fails,
the reader searches for the next gzip member or version line from which a whole record passes all checks, goes on there,
and returns the bytes between as a gap with the failed check. Records and gaps together cover every byte of the archive.
In a damaged plain record, a whole record quoted in its payload can't be told from a later one and is recovered.

A null payload is empty, a null key is smaller than all others, a null URI is left out; a URI with white space or control
characters is written URL-encoded. Repeated rows are records of their own, one of them the response. Columns other than
key, URI and payload are left out; an empty table gives an empty archive, and that no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalens.llm.common import by_value, materialize, shared_folder, slices
from quotalens.session import shuffle_width

by_value(__name__)

#: Bytes from which an equal payload is a revisit, and bytes of payload in an archive.
LEAST, ARCHIVE_BYTES = 1000, 16 << 20

#: Fixed by the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0\0\0\0\0\0\0\0\0"
MAGIC, VERSION, LINE, ENDING = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n", b"\r\n\r\n"


# --- Writing ----------------------------------------------------------------------------------------------------

def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def key_of(record_id: str) -> Column:
    """The key of a record, from its id."""
    return F.expr("try_cast(digits AS long)".replace("digits", f"regexp_extract({record_id}, '^<urn:x-record:(-?[0-9]*)>$', 1)"))


def revisits(rows: DataFrame) -> DataFrame:
    """(row, response): rows whose payload is written elsewhere, and the key of its response. ``rows``: row, key, digest, size."""
    held = rows.filter(F.col("size") >= LEAST).select("row", "key", "digest")
    groups = held.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "row")).alias("most")).filter(F.col("n") > 1)
    groups = materialize(groups.select("digest", "n", F.col("most.key").alias("response"), F.col("most.row").alias("most")), "payload-groups")
    # At most 4 x width digests hold more than this many rows.
    many = F.lit(max(2, -(-rows.count() // (4 * shuffle_width(rows)))))
    hot, other = groups.filter(F.col("n") > many), groups.filter(F.col("n") <= many)
    hot_rows = held.join(F.broadcast(hot), "digest")
    other_rows = held.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(other, "digest")
    return hot_rows.unionByName(other_rows).filter(F.col("row") != F.col("most")).select("row", "response")


def _records(df: DataFrame, date: str) -> DataFrame:
    """One record a row, without its closing line pair. ``df``: key, uri, payload, digest, size, response, revisit."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    uri = F.when(F.col("uri").rlike(r"[\x00-\x20\x7F]"), F.url_encode("uri")).otherwise(F.col("uri"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    made = df.withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", _record_id(F.col("key"))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _record_id(F.col("response"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")))
    return made.select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, 4 << 20):
            done = []
            for record in piece.column(0):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                done.append(z.compress(record.as_buffer()) + z.compress(ENDING) + z.flush())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])


def write_archives(
    df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", compress: bool = True,
    archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for every row of ``df`` into a new folder of archives."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    held = archive_folder(df.sparkSession, "payloads")  # fixes the row numbers
    rows.write.option("compression", "zstd").parquet(held)
    rows = df.sparkSession.read.schema(rows.schema).parquet(held)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    archives = max(shuffle_width(df), -(-total // archive_bytes))
    again = revisits(rows.select("row", "key", "digest", "size")).withColumn("revisit", F.lit(True)).repartition(archives, "row")
    dealt = rows.repartition(archives, "row").join(again, "row", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    records = _records(dealt, date)
    if compress:
        packed = records.select(F.col("value").cast("binary").alias("value")).mapInArrow(_members, "value binary")
        # The text writer puts out the bytes of a string as they are; the encoding is that of the separator.
        text = packed.select(F.col("value").cast("string").alias("value")).write.format("text")
        text.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).save(path)
    else:
        records.write.text(path, lineSep=ENDING.decode())


# --- Reading ----------------------------------------------------------------------------------------------------

_TYPES = (b"response", b"revisit", b"request", b"resource", b"metadata", b"warcinfo", b"conversion", b"continuation")
_HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


class Damaged(Exception):
    """A failed check."""


def fields_of(head: bytes) -> dict[str, bytes]:
    """Header fields by lower-case name; a line that begins with white space continues the one before."""
    out: dict[str, bytes] = {}
    last = None
    for line in head.split(LINE):
        if line[:1] in (b" ", b"\t") and last:
            out[last] = (out[last] + b" " + line.strip()).strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+\-.^-z|~0-9A-Z]+", name):
            raise Damaged("header line")
        last = name.decode("ascii").lower()
        out[last] = value.strip()
    return out


def plain_digest(label: bytes) -> tuple[str, str]:
    """Algorithm and lower-case hex digits of ``algorithm:digits``, where digits are hex or base 32."""
    kind, _, digits = label.decode("latin-1").partition(":")
    kind = kind.lower().replace("-", "")
    if kind in _HASHES and len(digits) != 2 * _HASHES[kind]().digest_size:
        try:
            digits = base64.b32decode(digits.upper() + "=" * (-len(digits) % 8)).hex()
        except binascii.Error:
            raise Damaged("digest") from None
    return kind, digits.lower()


def _check(name: str, label: bytes | None, data: memoryview) -> None:
    if label is not None:
        kind, digits = plain_digest(label)
        if kind in _HASHES and _HASHES[kind](data).hexdigest() != digits:
            raise Damaged(name)


def parse_record(data: bytes, at: int) -> tuple[int, dict]:
    """End and contents of the record that starts at a place, or :class:`Damaged` with the first failed check."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damaged("version line")
    first = at + len(VERSION) + 3
    stop = data.find(ENDING, first - 2)
    if stop < 0:
        raise Damaged("end of headers")
    head = fields_of(data[first:stop]) if stop > first else {}
    length = head.get("content-length", b"")
    if not re.fullmatch(rb"[0-9]{1,18}", length):
        raise Damaged("content length")
    if head.get("warc-type", b"").lower() not in _TYPES or "warc-record-id" not in head:
        raise Damaged("mandatory header")
    begin = stop + len(ENDING)
    end = begin + int(length)
    if end + len(ENDING) > len(data):
        raise Damaged("truncated record")
    if data[end:end + len(ENDING)] != ENDING:
        raise Damaged("record end")
    block = memoryview(data)[begin:end]
    _check("block digest", head.get("warc-block-digest"), block)
    kind = head["warc-type"].lower()
    label, size, payload = head.get("warc-payload-digest"), None, begin
    if head.get("content-type", b"").lower().startswith(b"application/http"):
        cut = data.find(ENDING, begin, end)
        payload = cut + len(ENDING) if cut >= 0 else end
        http = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", data[begin:payload], re.I)
        size = int(http[1]) if http else None
    if kind != b"revisit":
        body = memoryview(data)[payload:end]
        _check("payload digest", label, body)
        if size is not None and size != len(body):
            raise Damaged("payload length")
        size = len(body)
        digest = plain_digest(label)[1] if label else hashlib.sha1(body).hexdigest()
    else:
        digest = plain_digest(label)[1] if label else None
    text = {name: head[field].decode("utf-8", "replace") if field in head else None
            for name, field in (("record_id", "warc-record-id"), ("uri", "warc-target-uri"), ("date", "warc-date"), ("refers_to", "warc-refers-to"))}
    return end + len(ENDING), {**text, "record_type": kind.decode(), "payload_bytes": size, "payload_digest": digest, "payload": (payload, end)}


def inflate(data: bytes, at: int) -> tuple[int, bytes]:
    """End and content of the gzip member that starts at a place. Data go in by small parts, so that its end copies little of the rest."""
    z, view, out, step = zlib.decompressobj(31), memoryview(data), [], 1 << 13
    while not z.eof:
        if at >= len(data):
            raise Damaged("truncated member")
        try:
            out.append(z.decompress(view[at:at + step]))
        except zlib.error:
            raise Damaged("member check") from None
        at = min(len(data), at + step)
        step = min(2 * step, 1 << 20)
    return at - len(z.unused_data), b"".join(out)


def _record_at(data: bytes, at: int, strict: bool) -> tuple[int, bytes | None, dict | None]:
    """End, member content (None if plain) and record (None for a member that is empty) at a place.

    ``strict``: after damage; the member's first record has to pass, and an empty member is no place to go on.
    """
    if data[at:at + 3] != MAGIC:
        stop, record = parse_record(data, at)
        return stop, None, record
    stop, content = inflate(data, at)
    if strict or content:
        try:
            parse_record(content, 0)
        except Damaged as reason:
            if strict or not content.startswith(VERSION):
                raise Damaged(str(reason) if content else "empty member") from None
    return stop, content, None


def _next(data: bytes, at: int, members: bool) -> tuple[int, tuple | None]:
    """The next place from which all checks pass, and what stands there."""
    place = {MAGIC: data.find(MAGIC, at) if members else -1, VERSION: data.find(VERSION, at)}
    while True:
        mark = min((m for m in place if place[m] >= 0), key=place.get, default=None)
        if mark is None:
            return len(data), None
        try:
            return place[mark], _record_at(data, place[mark], True)
        except Damaged:
            place[mark] = data.find(mark, place[mark] + 1)


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[int, int, int, int, dict | None, str | None, bytes]]:
    """(place, size, place in the member, size there, record, failed check, bytes the record's payload lies in) of records and gaps, in order."""
    at, found = 0, None
    while at < len(data):
        try:
            stop, content, record = found or _record_at(data, at, False)
            found = None
        except Damaged as reason:
            after, found = _next(data, at + 1, members)
            yield at, after - at, 0, 0, None, str(reason), b""
            at = after
            continue
        if content is None:
            yield at, stop - at, 0, 0, record, None, data
        else:
            for inner, size, _, _, record, reason, held in salvage(content, False):
                yield at, stop - at, inner, size, record, reason, held
        at = stop


SCHEMA = (
    "file string, place long, size long, member_place long, member_size long, failed_check string, record_type string, record_id string, uri string, "
    "date string, refers_to string, payload_digest string, payload_bytes long, payload binary")
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[p.split()[1]]) for n, p in zip(_NAMES, SCHEMA.split(", "))])


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for place, length, inner, part, record, reason, held in salvage(content.as_py()):
                    row = {"file": file.as_py(), "place": place, "size": length, "member_place": inner, "member_size": part, "failed_check": reason}
                    if record:
                        a, b = record["payload"]
                        row |= {**record, "payload": held[a:b] if payloads else None}
                        size += b - a if payloads else 0
                    rows.append(row)
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in a folder: a gap names its ``failed_check``, a record has none.

    ``place`` and ``size`` are bytes of the file, ``member_place`` and ``member_size`` of the content of the member there
    (zero in a plain archive). ``payloads=False`` checks payloads but leaves them out.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(_read(payloads), SCHEMA)


def records(found: DataFrame) -> DataFrame:
    return found.filter(F.col("failed_check").isNull()).drop("failed_check")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: bytes that are part of no valid record."""
    return found.filter(F.col("failed_check").isNotNull()).select("file", "place", "size", "member_place", "member_size", "failed_check")


def archive_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors reach it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
