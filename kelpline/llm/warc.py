"""WARC archives: a writer through Spark's own committed sink, and a reader that salvages.

Each record is a gzip member. Spark's text sink writes a column's bytes as they are and a separator
after each row; here a row is a chunk of members. A member of under 16 MiB ends with a zero byte, the
highest of its length, so with a zero byte as separator the sink completes the chunk's last member,
and a longer one is followed by one zero byte of padding, which gzip readers skip. The sink's commit
protocol makes the write safe if executors are lost, on any file system that Spark knows.

The reader takes whole files as rows, so an archive should stay under some hundred MB. The writer
starts another after MOST_CHUNKS chunks, each of at most CHUNK bytes or one longer member, so an
archive is bounded in bytes, but for members that are longer themselves. Compressed and plain
archives are both read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import stage_table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
VERSION_LINE = re.compile(rb"WARC/[0-9]{1,2}\.[0-9]{1,2}(\r?\n)")
MEMBER = b"\x1f\x8b\x08"
#: Bytes of members that make one row of the sink, and rows of one archive: 128 MB together.
CHUNK, MOST_CHUNKS = 8_000_000, 16
#: Bytes fed to the decompressor at a time.
STEP = 16_384


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", most_broadcast: int = 100_000) -> DataFrame:
    """Rows to write: ``key``, ``uri``, ``payload`` (binary), ``digest`` (hex SHA-256), ``refers_to``.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest key are
    responses and the others revisit it. A null payload is empty, a null key never the smallest.
    Digests that occur once take no part in the join; the others are broadcast if a check shows
    that there are few, each of fixed size, and joined by a shuffle beyond that.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("uri"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = stage_table(firsts, "firsts")
    few = len(firsts.take(most_broadcast + 1)) <= most_broadcast
    joined = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    refers = F.when(F.octet_length("payload") >= LEAST_REVISIT, F.when(F.col("key").isNull() | (F.col("key") > F.col("first")), F.col("first")))
    return joined.select("key", "uri", "payload", "digest", refers.alias("refers_to"))


def record(key, uri: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\r\n]", "", uri)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{'' if key is None else key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6, chunk_bytes: int = CHUNK, most_chunks: int = MOST_CHUNKS) -> None:
    """Write the rows of ``plan_records`` into the new ``folder``, each task into archives of at most ``most_chunks`` chunks.

    An empty table makes a folder without records. A payload is held in memory once more as it is
    packed, so the longest is bounded by that of a worker; Arrow takes no single value over 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "uri", "payload", "digest", "refers_to"))):
                data = member(record(*(x.as_py() for x in row), date), level)
                if held and size + len(data) > chunk_bytes:
                    yield chunk(held)
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            yield chunk(held)

    def chunk(members: list[bytes]) -> pa.RecordBatch:
        """One row of the sink, which adds a zero byte."""
        data = b"".join(members)
        return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data[-1] == 0 else data], pa.binary())], ["value"])

    # A cast from binary keeps the bytes as they are.
    records.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", most_chunks).text(folder)


@dataclass
class Found:
    """A record, or with ``reason`` a quarantined gap, at ``start`` to ``stop`` of the file."""

    start: int
    stop: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


def one_record(data: bytes, at: int) -> tuple[Found | None, str]:
    """The record that starts at ``at`` of uncompressed ``data``, or why there is none."""
    version = VERSION_LINE.match(data, at)
    if not version:
        return None, "no version line"
    blank = 2 * version[1]
    end = data.find(blank, at)
    if end < 0:
        return None, "header without end"
    headers = {}
    for line in data[at:end].decode("utf-8", "replace").split(version[1].decode())[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None, "malformed header"
        name = name.strip().lower()
        if name in headers and name != "warc-concurrent-to":
            return None, "repeated header"  # a header that was cut short runs into the next record's
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return None, "no length"
    start = end + len(blank)
    stop = start + int(length)
    if data[stop : stop + len(blank)] != blank:
        return None, "truncated or wrong length"
    block = data[start:stop]
    if (claim := headers.get("warc-block-digest", "")).startswith("sha256:") and hashlib.sha256(block).hexdigest() != claim[7:]:
        return None, "block digest differs"
    return Found(at, stop + len(blank), headers, block), ""


def plain_records(data: bytes) -> Iterator[Found]:
    """Records and gaps of uncompressed data; after a failed check, on from the next version line."""
    at = 0
    while at < len(data):
        found, why = one_record(data, at)
        if found is None:
            after = VERSION_LINE.search(data, at + 1)
            found = Found(at, after.start() if after else len(data), reason=why)
        yield found
        at = found.stop


def one_member(data: bytes, at: int, marks: list[tuple[int, int]] | None = None) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, where it stops, and why it can't be read to its end.

    Data are fed in small steps, so a member costs what it holds and not what follows it. Of a
    member that breaks there is what was unpacked before, and where it broke. ``marks`` takes, for
    each step, how far data were read and how many bytes they gave.
    """
    if data[at : at + 3] != MEMBER:
        return b"", at, "no member"
    unpack, parts, upto, step, made = zlib.decompressobj(31), [], at, STEP, 0
    fine = None
    while not unpack.eof and upto < len(data):
        try:
            if step > 1:
                fine = unpack.copy()
            parts.append(unpack.decompress(data[upto : upto + step]))
            upto = min(upto + step, len(data))
            made += len(parts[-1])
            if marks is not None and step > 1:
                marks.append((upto, made))
        except zlib.error as error:
            if step == 1:
                return b"".join(parts), upto, f"bad member: {error}"
            unpack, step = fine, 1  # once more from before this step, up to the very byte
    if not unpack.eof:
        return b"".join(parts), upto, "truncated member"
    return b"".join(parts), upto - len(unpack.unused_data), ""


def unbroken_records(content: bytes, why: str) -> Iterator[Found]:
    """The sound records of what was unpacked of a member that breaks.

    If it is merely cut short, what came before is as it was. Otherwise bytes before the failure may
    be wrong too, so only records whose block digest was checked count.
    """
    for found in plain_records(content):
        if found.headers is not None and (why == "truncated member" or found.headers.get("warc-block-digest", "").startswith("sha256:")):
            yield found


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, of gzip members, plain records or both.

    Offsets of records in a member are those of the member. After each failure reading goes on from
    the nearer of the next member and the next version line; a member counts if it is valid, or
    begins with a version line. Records before and after a failure inside a member are kept, also
    if the member breaks there. The gap of a member that breaks starts, to within a step of the
    decompressor, behind the bytes of the records with checked digests that it begins with, and the
    search goes on there. Zero bytes at the start and after members are padding.
    """
    at, version, padded = 0, -1, True
    reach, unpacked = 0, set()  # a member that broke was read up to there, and records with these marks were taken from it
    while at < len(data):
        if padded and data[at] == 0:
            at += 1
            continue
        if data[at : at + 3] == MEMBER:
            marks: list[tuple[int, int]] = []
            content, stop, why = one_member(data, at, marks)
            if not why:
                for found in plain_records(content):
                    yield Found(at, stop, found.headers, found.block, found.reason)
                at, padded = stop, True
                continue
            sound = list(unbroken_records(content, why))
            reach, unpacked = stop, set(map(mark_of, sound))
            good = recovered_until(at, sound, marks)
        else:
            found, why = one_record(data, at)
            if found is not None:
                if at >= reach or mark_of(found) not in unpacked:  # stored members show their records plainly
                    yield found
                at, padded = found.stop, False
                continue
            sound, good = [], at
        onward = max(at + 1, good)
        if version < onward:
            after = VERSION_LINE.search(data, onward)
            version = after.start() if after else len(data)
        stop = next_member(data, onward, version)
        for found in sound:
            yield Found(at, stop, found.headers, found.block)
        yield Found(min(good, stop - 1), stop, reason=why)
        at, padded = stop, False


def mark_of(found: Found) -> bytes:
    """A digest of a record's headers and block."""
    return hashlib.sha256(repr(sorted(found.headers.items())).encode() + found.block).digest()


def recovered_until(at: int, sound: list[Found], marks: list[tuple[int, int]]) -> int:
    """Up to where data of the member at ``at`` gave nothing but the ``sound`` records with digests that its content begins with."""
    clean = 0
    for found in sound:
        if found.start == clean and found.headers.get("warc-block-digest", "").startswith("sha256:"):
            clean = found.stop
    return max((upto for upto, made in marks if made <= clean), default=at)


def next_member(data: bytes, at: int, before: int) -> int:
    """Where the next member starts that is valid or begins with a version line, or else ``before``."""
    while (at := data.find(MEMBER, at, before)) >= 0:
        content, _, why = one_member(data, at)
        if not why or VERSION_LINE.match(content):
            return at
        at += 1
    return before


READ = "path string, start long, stop long, reason string, record_type string, record_id string, refers_to string, uri string, claimed_digest string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record and per gap of all files of ``folder``.

    Records have a null ``reason``; gaps have one, with the byte range that was passed over, and
    nothing else. ``payload`` (null for revisits, and without ``with_payload``) is the body of the
    HTTP message; ``payload_bytes`` is its length, for revisits as their HTTP header states it;
    ``payload_digest`` is computed for responses and as claimed for revisits. A response whose
    computed digest isn't the claimed one is a gap. An empty file gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), *((c, pa.string()) for c in ("record_type", "record_id", "refers_to", "uri", "claimed_digest")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                out, size = [], 0
                for found in salvage(data.as_py()):
                    out.append({"path": path.as_py(), "start": found.start, "stop": found.stop} | described(found, with_payload))
                    size += len(found.block) * with_payload + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, READ)


def described(found: Found, with_payload: bool) -> dict:
    if found.headers is None:
        return {"reason": found.reason}
    h = found.headers
    http, gap, payload = found.block.partition(b"\r\n\r\n")
    claimed = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if h.get("warc-type") == "revisit":
        length = re.search(rb"(?im)^content-length: *([0-9]+)", http)
        n, digest, payload = int(length[1]) if length else None, claimed, None
    else:
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if h.get("warc-payload-digest", "").startswith("sha256:") and claimed != digest:
            return {"reason": "payload digest differs"}
    return {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "claimed_digest": claimed, "payload_bytes": n, "payload_digest": digest, "payload": payload if with_payload else None}


def key_of(record_id: Column) -> Column:
    """The key in a record id that this writer made, as a string; null if it has none."""
    found = F.regexp_extract(record_id, "^<urn:record:(.*)>$", 1)
    return F.when(found != "", found)
