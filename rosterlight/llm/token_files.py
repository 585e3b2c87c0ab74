"""Token files: documents as flat files of unsigned integers with 64-bit document offsets, to be memory-mapped.

A data set is a folder of pairs of files, each pair a run of documents in id order, and a table of the files:

* ``NAME.ids``: the ids of all its documents, one after another, as little-endian unsigned integers of 16 bits (32 where
  the vocabulary needs them), without a header, so that the whole file is one array.
* ``NAME.idx``: a header of 32 bytes (magic, version, bytes of an id, documents, ids), then documents + 1 places in
  ``NAME.ids`` as little-endian unsigned 64-bit integers, counted in ids; the last is the number of ids.
* ``NAME.docs``: an Arrow file with the documents' own ids, of any type.

The files know nothing of each other, so a task that is lost writes its files again and no other.  The place of a file in
the whole order comes from the table: a prefix sum over one row a file gives the number of documents and ids before it.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  pa.fs below
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored
from .packing import END_ID, loaded
from .warc import filesystem

MAGIC, VERSION = b"TOKENIDS", 1
_HEADER = struct.Struct("<8sIIQQ")
FILE_BYTES = 64 << 20
READ_BYTES = 16 << 20
_PER_TASK = 4  # the least MB for which a further file is opened, while cores stand idle
TABLE = "name string, part int, documents long, ids long, width int"


def id_width(vocabulary: str) -> int:
    """2 if every id of the vocabulary, and the end id, fits 16 bits; else 4."""
    return 2 if loaded(vocabulary).model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _encoded(texts: pa.Array, vocabulary: str, width: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with the ids of their texts, each with the end id behind it, as the bytes that go to a file."""
    tokens, end = loaded(vocabulary), np.uint32(END_ID).tobytes()
    for i in range(0, len(texts), 512):
        some = [raw + end for raw in tokens.encode_batch(texts.slice(i, 512).to_pylist())]
        yield i, i + len(some), some if width == 4 else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in some]


class _Writer:
    """The three files of one run of documents, written under a name of their own and renamed together at the end."""

    def __init__(self, fs: pa.fs.FileSystem, root: str, width: int, kind: pa.DataType):
        self.fs, self.root, self.width, self.name = fs, root, width, uuid.uuid4().hex
        self.ends, self.total = [np.zeros(1, "<u8")], 0
        self.ids = fs.open_output_stream(f"{root}/{self.name}.ids.part", compression=None)
        self.names = fs.open_output_stream(f"{root}/{self.name}.docs.part", compression=None)
        self.docs = pa.ipc.new_file(self.names, pa.schema([("id", kind)]))

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids], ["id"]))
        ends = self.total + np.cumsum([len(x) // self.width for x in ids]).astype("<u8")
        self.ids.write(b"".join(ids))
        self.ends.append(ends)
        self.total = int(ends[-1])

    def close(self, part: int) -> dict:
        places = np.concatenate(self.ends)
        self.docs.close()
        self.names.close()
        self.ids.close()
        with self.fs.open_output_stream(f"{self.root}/{self.name}.idx.part", compression=None) as out:
            out.write(_HEADER.pack(MAGIC, VERSION, self.width, len(places) - 1, self.total))
            out.write(places.tobytes())
        for kind in ("ids", "docs", "idx"):
            self.fs.move(f"{self.root}/{self.name}.{kind}.part", f"{self.root}/{self.name}.{kind}")
        return {"name": self.name, "part": part, "documents": len(places) - 1, "ids": self.total, "width": self.width}


def written(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``docs`` to ``folder`` in ascending order of id; returns the table of the files, also stored there as ``files``.

    The table: name, part, documents, ids, width, first_document and first_id (how many come before the file).  Ranges of
    ids come from Spark's sample of the keys, one file a range of about ``file_bytes`` of text; equal ids stand in order of
    their texts' hash, null ids first.  Rows that repeat id and text are kept, next to each other, in one file however many
    they are (the task streams them).  A file is counted only if its task's result is, so what a lost task leaves behind
    is never read.  An empty table has no files.
    """
    spark = docs.sparkSession
    width = id_width(vocabulary)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, math.ceil(total / file_bytes), min(cores, total // (_PER_TASK << 20)))
    dealt = rows.repartitionByRange(files, "id", "hash").sortWithinPartitions("id", "hash").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if out is None and b.num_rows:
                fs, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                out = _Writer(fs, root, width, b.schema.field(0).type)
            for first, last, ids in _encoded(b.column(1), vocabulary, width):
                out.add(b.column(0).slice(first, last - first), ids)
        if out is not None:
            yield pa.RecordBatch.from_pylist([out.close(TaskContext.get().partitionId())], pa.schema([("name", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))

    made = stored(dealt.mapInArrow(run, TABLE), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = made.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"first_{c.rstrip('s')}") for c in ("documents", "ids")])
    bases.write.mode("error").parquet(f"{folder}/files")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """The table of the files of a data set."""
    return spark.read.schema(f"{TABLE}, first_document long, first_id long").parquet(f"{folder}/files")


class Mapped:
    """One file of a data set, memory-mapped where its file system is the machine's own, else read by ranges."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.path = f"{root}/{name}"
        local = isinstance(self.fs, pa.fs.LocalFileSystem)
        self._open = (lambda kind: pa.memory_map(f"{self.path}.{kind}")) if local else (lambda kind: self.fs.open_input_file(f"{self.path}.{kind}"))
        self._idx = self._open("idx")
        magic, version, self.width, self.documents, self.ids = _HEADER.unpack(self._idx.read_at(_HEADER.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{self.path}.idx is no index of token ids")
        self._ids = self._open("ids")
        if self._ids.size() != self.ids * self.width:
            raise ValueError(f"{self.path}.ids holds {self._ids.size()} bytes, not {self.ids} ids of {self.width} bytes")

    def places(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last`` start, the one behind the last too, in ids."""
        return np.frombuffer(self._idx.read_at(8 * (last - first + 1), _HEADER.size + 8 * first), "<u8").astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, across documents; no copy where the file is memory-mapped."""
        return np.frombuffer(self._ids.read_at(self.width * (stop - start), self.width * start), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        start, stop = self.places(k, k + 1).tolist()
        return self.tokens(start, stop)

    def names(self) -> Iterator[pa.Array]:
        """The documents' own ids, batch by batch."""
        reader = pa.ipc.open_file(self._open("docs"))
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i).column(0)


def documents(spark: SparkSession, folder: str, id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """Reads a data set back: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (array of long).

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers.  A file is read by several tasks, each taking
    the documents that start in its range of about 16 MB of ids; a document of any length is one task's.
    """
    files = opened(spark, folder)
    step = F.greatest(F.lit(1), (F.lit(READ_BYTES) / F.col("width")).cast("long"))
    ranges = files.select("name", "first_id", "ids", step.alias("step"), F.explode(F.sequence(F.lit(0), F.col("ids") - 1, step)).alias("low"))
    n = max(1, ranges.count())
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                file = Mapped(folder, r["name"])
                place = file.places(0, file.documents)
                first, last = np.searchsorted(place[:-1], [r["low"], r["low"] + r["step"]]).tolist()
                row = 0
                for own in file.names():
                    low, high = max(first, row), min(last, row + len(own))
                    if low < high:
                        some = [file.tokens(*place[k : k + 2].tolist()) for k in range(low, high)]
                        columns = [own.slice(low - row, high - low), pa.array(r["first_id"] + place[low:high]), pa.array(np.diff(place[low : high + 1])), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in some], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype(np.int64) for x in some], pa.list_(pa.int64()))] * with_ids, names)
                    row += len(own)

    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return ranges.repartition(n, "name", "low").mapInArrow(run, schema)


def report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes ``docs`` as a data set and reads it back: id, start, n_tokens, ids_crc32 of every document.

    A null text is an empty one, which still has the end id.  Texts of any length, repeated rows, null ids, empty tables
    and clashing columns: see ``written``; other columns play no part.
    """
    folder = folder or new_path(docs.sparkSession, "token-ids")
    written(docs, vocabulary, folder, id_col, text_col)
    return documents(docs.sparkSession, folder, docs.schema[id_col].dataType.simpleString(), with_ids=False).withColumnRenamed("id", id_col)
