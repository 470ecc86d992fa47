"""WARC archives: a writer with one gzip member a record, and a splittable reader.

Writing. Each task writes one ``.warc.gz`` file into the shared folder under a
name of its own and yields one manifest row (path, bytes, records). The manifest
is written as Parquet, so Spark's commit decides which attempt's file counts; a
file that a lost or repeated attempt left is in no manifest and never read.
Of records with equal payloads of at least ``revisit_from`` bytes the one with
the largest page_id is a response, the others are revisits that refer to it and
hold the HTTP header alone (Content-Length is that of the full payload).

Reading. Files are cut into byte ranges, dealt over the tasks. A task scans its
range for the gzip magic, accepts a candidate if it decodes to a WARC header, and
from there follows member by member. It owns the records whose member starts in
the range and reads past its end to complete the last one. A member that is
damaged is skipped and the scan goes on behind its magic. Memory: one range's
chunk and one record.

Files are reached by ``pyarrow.fs``, from any file system that it knows (local
or shared folders, HDFS, S3 and others). Payloads that are themselves WARC
members, stored without compression, would be taken for records where a range
begins inside them; UTF-8 text can't hold the magic.

Null html is an empty payload, a null url has no target header and comes back
null; control characters of a url, not legal there, come back percent-encoded.
A null page_id is smaller than every other. Rows that repeat the largest page_id
of a payload are all responses. An empty table gives no records. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnlake.llm.common import byte_texts, staged
from bnlake.session import ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a member that are decoded to look for a WARC header, and read at a time.
PROBE, CHUNK = 4096, 1 << 20
CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD = "record_id string, page_id long, type string, url string, refers_to long, digest string, payload_bytes long, payload binary, intact boolean"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def digest32(payload: bytes) -> str:
    """SHA-1 as WARC writes it: base 32, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC 1.1 record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes) -> dict | None:
    """A record's fields; None if it is no WARC record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    h = headers(head)
    try:
        block = rest[:int(h["content-length"])]
    except (KeyError, ValueError):
        return None
    payload, size = block, None
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = headers(http).get("content-length", "")
        size = int(said) if said.isdigit() else None
    kind = h.get("warc-type")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = kind == "revisit"
    return {"record_id": h.get("warc-record-id"), "page_id": page_of(h.get("warc-record-id")), "type": kind,
            "url": h.get("warc-target-uri"), "refers_to": page_of(h.get("warc-refers-to")), "digest": digest,
            "payload_bytes": size if revisit else len(payload), "payload": None if revisit else payload,
            "intact": None if revisit or digest is None else digest32(payload) == digest}


class Range:
    """A file read from any place on, through one buffer of about a chunk."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def get(self, place: int, n: int) -> memoryview:
        """Up to n bytes from a place on; fewer at the end of the file."""
        have = self.base + len(self.data)
        if place < self.base or place > have or (place + n > have and have < self.size):
            self.file.seek(place)
            self.base, self.data = place, self.file.read(max(CHUNK, n))
        return memoryview(self.data)[place - self.base:place - self.base + n]

    def find_magic(self, place: int, end: int) -> int | None:
        """The first magic that starts in [place, end)."""
        step = len(MAGIC)  # a member mostly follows at once
        while place < end:
            stop = min(end, place + step)
            at = bytes(self.get(place, stop - place + len(MAGIC) - 1)).find(MAGIC)
            if at >= 0:
                return place + at
            place, step = stop, CHUNK
        return None

    def is_record(self, place: int) -> bool:
        """Whether the member at a place decodes to the start of a WARC record."""
        try:
            start = zlib.decompressobj(31).decompress(self.get(place, PROBE), 16)
        except zlib.error:
            return False
        return start.startswith(b"WARC/1.")

    def member(self, place: int) -> tuple[bytes, int] | None:
        """The decoded member at a place and where it ends; None if it is damaged."""
        z, out, at, step = zlib.decompressobj(31), io.BytesIO(), place, PROBE
        try:
            while not z.eof:
                piece = self.get(at, step)
                if not piece:
                    return None
                out.write(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
                step = min(2 * step, CHUNK)
        except zlib.error:
            return None
        return out.getvalue(), at


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The decoded records of a file whose members start in [start, end)."""
    r, place = Range(file), start
    while (at := r.find_magic(place, end)) is not None:
        found = r.member(at) if r.is_record(at) else None
        if found is None:
            place = at + 1
        else:
            yield found[0]
            place = found[1]


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = place = None
        n = size = 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1)]
            for page_id, url, html, to, revisit in zip(*cols, byte_texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if out is None:
                    place = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    where, path = _open(place)
                    where.create_dir(posixpath.dirname(path), recursive=True)
                    out = where.open_output_stream(path, compression=None)
                data = member(record(page_id, url, html or b"", to, revisit, date))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
                       ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])
    rows: list[dict] = []
    held = 0
    for b in batches:
        for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
            where, name = _open(path)
            with where.open_input_file(name) as f:
                for data in records_in(f, start, end):
                    row = parse(data)
                    if row is not None:
                        rows.append(row)
                        held += len(data)
                        if held >= CHUNK * 8:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kinds)


def with_revisits(pages: DataFrame, revisit_from: int = 0, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """(page_id, url, html, refers_to, revisit). Only payloads that occur more than
    once are joined back: broadcast up to ``broadcast_rows`` of them (some 60 bytes
    each), else by a shuffle that deals every payload's rows over ``salts`` keys."""
    body = F.coalesce("html", F.lit(""))
    key = F.struct(F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", key.alias("__key"))
    many = rows.filter(F.col("__key.size") >= revisit_from).groupBy("__key").agg(F.max("page_id").alias("__to"), F.count("*").alias("__n"))
    many = staged(many.filter("__n > 1 and __to is not null").select("__key", "__to"), "warc-copies")
    if many.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(many), "__key", "left")
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        many = many.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(many, ["__key", "__salt"], "left")
    # no copy: no target
    revisit = F.col("__to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__to"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("__to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, revisit_from: int = 0, date: str = "2000-01-01T00:00:00Z", **how) -> DataFrame:
    """Archives of pages (page_id, url, html) in ``folder`` (default: a new one in the
    session's shared folder), one a task; their manifest (path, bytes, records)."""
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    made = with_revisits(pages, revisit_from, **how).mapInArrow(_write(folder, date), "path string, bytes long, records long")
    return staged(made, "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """The records of the files of a manifest (path, bytes): record_id, page_id, type,
    url, refers_to, digest, payload_bytes, payload (null for revisits), intact (whether
    the payload has the digest)."""
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(int(min(n, 100_000))).mapInArrow(_read, RECORD)
