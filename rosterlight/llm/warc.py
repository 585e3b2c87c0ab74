"""WARC archives: a writer with one gzip member per record, and a reader whose tasks split files by byte range.

A task owns the records whose member starts inside its range.  It looks for the gzip magic, takes a place as a record
only if what it unpacks there begins with a WARC version line and a whole header block, and then reads on from member
to member; the last may end beyond the range.  Files are reached through ``pyarrow.fs``, by URI.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
BLOCK = 1 << 20
_DATE = "2024-01-01T00:00:00Z"  # archives are rebuilt from tables: the same rows give the same bytes
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SCHEMA = "path string, offset long, type string, record_id string, url string, digest string, refers_to string, payload_bytes long, payload binary"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":/" in uri else f"file://{uri}")


def with_record_types(pages: DataFrame, id_col: str, least_bytes: int = 100) -> DataFrame:
    """``pages`` (id, url, payload binary) with digest, record_type and refers_to.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response and
    the others revisit it.  A null id loses against any other; a group with null ids only, and shorter payloads, are
    all responses.  Rows that repeat the response's id and payload are responses too.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    size = F.length("payload").cast("long")
    first = rows.where(size >= least_bytes).groupBy("digest", size.alias("bytes")).agg(F.min(id_col).alias("first"))
    return (
        rows.join(first.select("digest", "first"), "digest", "left")
        .withColumn("record_type", F.when(F.col("first").isNull() | F.col(id_col).eqNullSafe(F.col("first")), "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first")))
        .drop("first")
    )


def _clean(x: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(x))


_PAGE = "urn:x-page:"


def _named(x: object) -> str:
    """An id as a record id: percent-encoded, so that any text comes back as it was."""
    return f"<{_PAGE}{quote(str(x), safe='')}>"


def _name(field: str | None) -> str | None:
    """The id in a record id; one of another writer as it stands, without its brackets."""
    if field is None:
        return None
    inside = field[1:-1] if field.startswith("<") and field.endswith(">") else field
    return unquote(inside[len(_PAGE) :]) if inside.startswith(_PAGE) else inside


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, kind: str, refers_to: object) -> bytes:
    """One record as a gzip member.  A null url has no WARC-Target-URI line, a null id no WARC-Record-ID."""
    body = b"" if kind == "revisit" else _HTTP % len(payload) + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        *([] if page_id is None else [f"WARC-Record-ID: {_named(page_id)}"]),
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_named(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", file_bytes: int = 256 << 20) -> DataFrame:
    """Writes ``pages`` (id, url, payload, digest, record_type, refers_to) as .warc.gz files in ``folder``; returns (path, bytes, records).

    A task writes under a name of its own and renames when done, so a task that is lost or run twice leaves no half
    file among those returned.  An empty table writes no file.
    """
    rows = pages.select(F.col(id_col).alias("id"), "url", "payload", "digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": n}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}.part", compression=None)
                member = record_bytes(r["id"], r["url"], r["payload"] or b"", r["digest"], r["record_type"], r["refers_to"])
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return rows.mapInArrow(run, "path string, bytes long, records long")


class _Range:
    """A file from a place on, read block by block; ``data[at:]`` lies ahead, and ``data[0]`` is the file's byte ``start``."""

    def __init__(self, source: pa.NativeFile, start: int, block: int):
        self.source, self.block, self.data, self.at = source, block, b"", 0
        self.go(start)

    def go(self, place: int) -> None:
        """On to a place, or back to it."""
        if self.data and self.start <= place <= self.start + len(self.data):
            self.at = place - self.start
        else:
            self.source.seek(place)
            self.data, self.start, self.at = b"", place, 0

    def more(self) -> bool:
        """Reads a block; what has been passed goes, so a member of any length is copied once."""
        got = self.source.read(self.block)
        self.data, self.start, self.at = self.data[self.at :] + got, self.start + self.at, 0
        return bool(got)

    @property
    def place(self) -> int:
        return self.start + self.at


def parse_record(raw: bytes) -> dict | None:
    """The fields of an unpacked record, or None if it isn't one."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(VERSION) or end < 0:
        return None
    head = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if sep:
            head[k.strip().lower()] = v.strip()
    size = head.get("content-length", "")
    if not size.isdigit() or len(raw) < end + 4 + int(size):
        return None
    body = raw[end + 4 : end + 4 + int(size)]
    if head.get("content-type", "").startswith("application/http"):
        body = body.partition(b"\r\n\r\n")[2]
    return {
        "type": head.get("warc-type"),
        "record_id": _name(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to": _name(head.get("warc-refers-to")),
        "payload_bytes": int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else len(body),
        "payload": body,
    }


def _member(r: _Range) -> bytes | None:
    """The member at the head of ``r`` unpacked, ``r`` moved behind it; None if no WARC record is there, ``r`` anywhere."""
    unpack, out = zlib.decompressobj(31), []
    seen, checked = b"", False
    while True:
        if r.at == len(r.data) and not r.more():
            return None  # cut off
        piece = r.data[r.at : r.at + 65536]
        try:
            got = unpack.decompress(piece)
        except zlib.error:
            return None
        r.at += len(piece)
        if not checked:
            seen += got
            if seen[: len(VERSION)] != VERSION[: len(seen)]:
                return None
            checked = len(seen) >= len(VERSION)  # from here on the member is read to its end, however long its header
        out.append(got)
        if unpack.eof:
            r.at -= len(unpack.unused_data)
            return b"".join(out)


def records_in_range(source: pa.NativeFile, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, dict]]:
    """The records of one file whose members start at ``start <= place < end``.  Damaged and cut-off members are passed over."""
    r = _Range(source, start, block)
    while r.place < end:
        at = r.data.find(MAGIC, r.at)
        if at < 0:
            r.at = max(r.at, len(r.data) - len(MAGIC) + 1)
            if not r.more():
                return
            continue
        r.at = at
        place = r.place
        if place >= end:
            return
        raw = _member(r)
        record = parse_record(raw) if raw is not None else None
        if record is None:
            r.go(place + 1)
            continue
        yield place, record


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = 32 << 20, most_tasks: int = 20_000) -> DataFrame:
    """The records of ``files`` (path, bytes), with payloads: one row per record, whichever way the files are split.

    There are as many tasks as splits, up to ``most_tasks``; their number is given, so that adaptive execution does not
    put the few bytes that name all splits into one task.
    """
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "bytes")
    splits = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"] or 1
    ranges = ranges.repartition(min(int(splits), most_tasks))
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64())] + [(c, pa.string()) for c in ("type", "record_id", "url", "digest", "refers_to")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.to_pylist():
                fs, path = filesystem(task["path"])
                with fs.open_input_file(path) as source:
                    rows, size = [], 0
                    for at, record in records_in_range(source, task["start"], min(task["start"] + split_bytes, task["bytes"])):
                        rows.append({"path": task["path"], "offset": at, **record})
                        size += len(record["payload"])
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(run, SCHEMA)


def lost_records(files: DataFrame, read: DataFrame) -> DataFrame:
    """path, records, found of the files of which ``read`` (with path) holds another number of records than were written."""
    found = read.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    return files.select("path", "records").join(found, "path", "left").select("path", "records", F.coalesce("found", F.lit(0)).alias("found")).where("records <> found")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """Writes a table of pages as archives in the shared folder; returns the files (path, bytes, records) and their records, read back.

    A null html is an empty payload.  Repeated rows are records of their own.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    files = stored(write_archives(with_record_types(rows, "id"), new_path(spark, "warc"), "id", file_bytes), "warc-files")
    return files, read_archives(spark, files)


def page_report(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per record of ``archived``: id, payload_bytes, payload_digest, record_type and refers_to.

    A response's figures come from the payload that was read; a revisit's from its header.  A file that gives back
    another number of records than were written into it (one is damaged or cut off) is an error.
    """
    kind = dict(pages.dtypes)[id_col]
    files, read = archived(pages, id_col)
    response = F.col("type") == "response"
    number = lambda c: F.expr(f"try_cast({c} AS {kind})")
    found = stored(
        read.select(
            "path",
            number("record_id").alias(id_col),
            F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
            F.col("type").alias("record_type"),
            number("refers_to").alias("refers_to"),
        ),
        "warc-report",
    )
    if lost := lost_records(files, found).take(3):
        raise RuntimeError("records lost in " + ", ".join(f"{r.path}: {r.found} of {r.records}" for r in lost))
    return found.drop("path")
