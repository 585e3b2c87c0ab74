"""Product codes of vectors: codebooks by Lloyd's rounds, with the filtering algorithm over kd-trees.

A vector is cut into equal parts, and each part position has a codebook.  A task builds kd-trees over the parts of its
rows, batch by batch, with the bounding box and the sum of every node.  All entries start at the root; on the way down an
entry goes where another one is nearer to every point of the node's box.  Where one entry is left, the whole node is its:
sum and count are added at once, and no point is looked at.  All figures are whole numbers, so the result does not
depend on how rows are dealt, on the trees, or on a task that runs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, stored
from .vectors import usable, whole, width

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAF = 8


class Tree:
    """A balanced kd-tree over ``points`` (m x 2^depth rows): points in tree order, boxes and sums of the nodes of every level."""

    def __init__(self, points: np.ndarray, depth: int):
        n, w = points.shape
        order = np.arange(n)
        for level in range(depth):
            cells = points[order].reshape(1 << level, -1, w)
            widest = (cells.max(1) - cells.min(1)).argmax(1)
            along = np.take_along_axis(cells, widest[:, None, None], 2)[:, :, 0]
            halves = np.argpartition(along, along.shape[1] // 2, axis=1)
            order = np.take_along_axis(order.reshape(1 << level, -1), halves, 1).ravel()
        self.order, self.points, self.depth = order, points[order], depth
        leaves = self.points.reshape(1 << depth, -1, w)
        self.low, self.high, self.sums = [leaves.min(1)], [leaves.max(1)], [leaves.sum(1)]
        for _ in range(depth):
            self.low.insert(0, self.low[0].reshape(-1, 2, w).min(1))
            self.high.insert(0, self.high[0].reshape(-1, 2, w).max(1))
            self.sums.insert(0, self.sums[0].reshape(-1, 2, w).sum(1))


def forest(points: np.ndarray) -> Iterator[tuple[int, Tree]]:
    """Trees over runs of ``points``, with the run's first row: leaves of 8 points, and one leaf of the few that are left."""
    at = 0
    while len(points) - at >= LEAF:
        depth = ((len(points) - at) // LEAF).bit_length() - 1
        yield at, Tree(points[at : at + (LEAF << depth)], depth)
        at += LEAF << depth
    if at < len(points):
        yield at, Tree(points[at:], 0)


def _heads(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])


def filtered(tree: Tree, book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The nearest entry of ``book`` for every point in tree order (ties: the lower one); adds to ``sums`` and ``counts`` by entry.

    Pairs of a node and an entry that may still be nearest to one of its points go down level by level.
    """
    n, w = tree.points.shape
    near = np.empty(n, np.int64)
    node, entry = np.zeros(len(book), np.int64), np.arange(len(book))
    for level in range(tree.depth + 1):
        low, high = tree.low[level][node], tree.high[level][node]
        z = book[entry]
        from_middle = ((2 * z - low - high) ** 2).sum(1)
        heads = _heads(node)
        group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(node)]))
        first = np.flatnonzero(from_middle == np.minimum.reduceat(from_middle, heads)[group])
        star = first[_heads(group[first])][group]  # the entry nearest to the middle of its node
        s = z[star]
        corner = np.where(z > s, high, low)  # of the box, the one most in favour of the entry
        behind = ((z - corner) ** 2).sum(1) - ((s - corner) ** 2).sum(1)
        left = (behind < 0) | ((behind == 0) & (entry <= entry[star]))
        node, entry, group = node[left], entry[left], group[left]
        heads = _heads(group)
        alone = np.bincount(group)[group] == 1
        whole_nodes, owner = node[alone], entry[alone]
        near.reshape(1 << level, -1)[whole_nodes] = owner[:, None]
        np.add.at(sums, owner, tree.sums[level][whole_nodes])
        np.add.at(counts, owner, n >> level)
        node, entry = node[~alone], entry[~alone]
        if not len(node):
            return near
        if level < tree.depth:
            node, entry = np.r_[2 * node, 2 * node + 1], np.r_[entry, entry]
            order = np.argsort(node, kind="stable")
            node, entry = node[order], entry[order]
    points = tree.points.reshape(1 << tree.depth, -1, w)[node]
    far = ((points - book[entry][:, None]) ** 2).sum(2)
    heads = _heads(node)
    group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(node)]))
    nearest = np.where(far == np.minimum.reduceat(far, heads)[group], entry[:, None], len(book))
    nearest = np.minimum.reduceat(nearest, heads)
    near.reshape(1 << tree.depth, -1)[node[heads]] = nearest
    for j in range(nearest.shape[1]):
        np.add.at(sums, nearest[:, j], points[heads, j])
    np.add.at(counts, nearest.ravel(), 1)
    return near


def _assigned(x: np.ndarray, books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and total squared distance of every row; sums and counts by (part, entry) are added to."""
    parts, _, w = books.shape
    codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for p in range(parts):
        points = np.ascontiguousarray(x[:, p * w : (p + 1) * w])
        for at, tree in forest(points):
            codes[at + tree.order, p] = filtered(tree, books[p], sums[p], counts[p])
        error += ((points - books[p][codes[:, p]]) ** 2).sum(1)
    return codes, error


def _start(rows: DataFrame, parts: int, entries: int, d: int) -> np.ndarray:
    """The codebooks of the rows with the smallest ids: parts x entries x width.  Nulls last; equal ids in order of their vectors."""
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    return whole(first.column("v").combine_chunks(), d).reshape(-1, parts, d // parts).transpose(1, 0, 2).copy()


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries without a part stay.  A task sends one row per entry that it used."""
    parts, entries, w = books.shape
    names = [f"s{j}" for j in range(w)]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
        for b in batches:
            _assigned(whole(b.column(0), parts * w), shared.value, sums, counts)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), *(pa.array(c) for c in np.ascontiguousarray(sums[part, entry].T))], ["part", "entry", "n", *names]
        )

    books_shape = books.shape
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]
    done = rows.select("v").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names)).groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)
    out = books.copy()
    for r in done.collect():  # at most one row per entry
        out[r["part"], r["entry"]] = [int(r[c]) // r["n"] for c in names]
    return out


def codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks after ``rounds`` rounds, as parts x entries x width; None without any usable vector."""
    rows = usable(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    d = width(rows, "v")
    if not d:
        return None
    if d % parts or not 0 < entries <= 256:
        raise ValueError(f"{d} entries cannot be cut into {parts} equal parts, or {entries} codebook entries do not fit a byte")
    books = _start(rows, parts, entries, d)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def coded(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", *more: str) -> DataFrame:
    """Each usable row as id, code (two hex digits a part), error, and the columns ``more``."""
    parts, _, w = books.shape
    rows = usable(vectors, vector_col).select(F.col(f"`{vector_col}`").alias("v"), F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"m{i}") for i, c in enumerate(more)])
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    names = ["id", *(f"m{i}" for i in range(len(more))), "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for b in batches:
            codes, error = _assigned(whole(b.column(0), parts * w), book, np.zeros_like(book), np.zeros(book.shape[:2], np.int64))
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], names)

    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{types}, code string, error long").toDF(id_col, *more, "code", "error")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' whole numbers in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each usable row: id, code, error, label_error (error summed over rows of its label, nulls together), codebooks_sha256.

    Null and empty vectors and those with null or non-finite entries are left out.  Fewer rows than ``entries`` give
    smaller codebooks.  Repeated rows count each time; of equal ids the smaller vector comes first in the codebooks, and
    null ids come last.  An empty table gives an empty result; other columns play no part.  Vectors of several lengths or
    of a length that ``parts`` does not divide, and entries that reach 2^28 times 1/256, are an error.
    """
    books = codebooks(vectors, id_col, vector_col, parts, entries, rounds)
    if books is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{vector_col}`").alias("v_"), F.col(f"`{label_col}`").alias("label_"))
    codes = stored(coded(rows, books, "id_", "v_", "label_"), "vector-codes")
    sums = codes.groupBy(F.col("label_").alias("of_"), apart(F.col("label_"))).agg(F.sum("error").alias("label_error"))
    found = codes.join(sums, codes["label_"].eqNullSafe(sums["of_"]))
    return found.select(F.col("id_").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
