"""MinHash near-dedup with one permutation.

One hash per shingle serves all bins: its high bits name the bin, and a bin's value is the smallest hash in it.  An empty
bin copies a full one that a fixed random sequence picks (optimal densification).  Bands of bins give buckets; in each
bucket every document is linked to the smallest id only, so that a bucket of n documents gives n - 1 candidate pairs.

A star can miss a link between two documents that are both unlike its centre.  So, once the stars' links are confirmed
and joined up, buckets that still hold several classes are looked at again: their documents go through an exact prefix
join (two sets with similarity s share one of the first |x| - ceil(s |x|) + 1 shingles, rarest first), which pairs
documents of different classes only.  Every link is confirmed on whole shingle sets.

Documents with one and the same shingle set are one node throughout; copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, dropped, stored
from .kernels import chained, mix, row_shingles, signed

BINS = 128
BAND = 4  # bins; 32 bands: a pair of similarity 0.8 shares none with probability 5e-8
MARKS = 16  # longs of parity marks of a set, a power of two
_TRIES = 256


def _sequences() -> np.ndarray:
    """For each bin the bins that it tries when empty."""
    n = np.arange(BINS * _TRIES, dtype=np.uint64)
    return (mix(n + np.uint64(0x5851F42D4C957F2D)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, _TRIES)


_SEQUENCES = _sequences()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``BINS`` values of a set of sorted distinct hashes, of which there is at least one."""
    bins = (shingles >> np.uint64(64 - 7)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    values = np.zeros(BINS, np.uint64)
    values[bins[first]] = shingles[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        source = np.full(len(empty), -1)
        open_ = np.arange(len(empty))
        for k in range(_TRIES):
            pick = _SEQUENCES[empty[open_], k]
            good = full[pick]
            source[open_[good]] = pick[good]
            open_ = open_[~good]
            if not len(open_):
                break
        held = bins[first]
        source[open_] = held[np.searchsorted(held, empty[open_]) % len(held)]  # else the next full bin
        values[empty] = values[source]
    return values


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash per band of the signature, the band's number mixed in."""
    v = signature(shingles).reshape(-1, BAND)
    return chained([v[:, i] for i in range(BAND)] + [np.arange(len(v), dtype=np.uint64)])


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes that name a set of shingles, of which there is at least one."""
    return int(signed(mix(shingles).sum(keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(shingles ^ np.uint64(0xA0761D6478BD642F)), keepdims=True))[0])


def signed_rows(docs: DataFrame, words: int) -> DataFrame:
    """(id, text) -> id, text, n_shingles, set hashes s1 and s2, bands array<long>; an empty set has null hashes and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, all_bands = [], [], [], []
            for x in row_shingles(b.column(1), words):
                n.append(len(x))
                if len(x):
                    for to, h in zip((s1, s2), set_hashes(x), strict=True):
                        to.append(h)
                    all_bands.append(signed(bands(x)))
                else:
                    s1.append(None)
                    s2.append(None)
            width = BINS // BAND
            at = np.concatenate([[0], np.cumsum([width * bool(k) for k in n])]).astype(np.int32)
            flat = np.concatenate(all_bands) if all_bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "text", "n_shingles", "s1", "s2", "bands"]
            )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, text string, n_shingles long, s1 long, s2 long, bands array<bigint>")


def similar(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of (a, b, text_a, text_b) the (a, b) whose whole sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                # a centre's text comes once for each of its pairs: runs of equal texts are cut into shingles once
                heads = part.column(2).to_pylist()
                new = [k for k in range(len(heads)) if k == 0 or heads[k] != heads[k - 1]]
                sets = list(row_shingles(pa.array([heads[k] for k in new], pa.string()), words))
                which = np.cumsum([k in set(new) for k in range(len(heads))]) - 1
                for k, y in enumerate(row_shingles(part.column(3), words)):
                    x = sets[which[k]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that hold.  Both joins read one shuffle of the texts by id."""
    left = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return similar(pairs.join(left, "b").join(right, "a"), words, percent)


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, root): each linked id with the smallest id that it reaches.

    Each round points every node at its smallest neighbour, follows pointers twice and contracts the links, so every node
    that still has a link meets another; the nodes with links at least halve, and a star is done in one round.  Rounds
    are written, so that none depends on the last, and the tables of the round before deleted.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    roots = None
    while edges.take(1):
        old = [edges] if roots is None else [edges, roots]
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
        up = both.groupBy("id", apart(F.col("id"))).agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to"))
        for _ in range(2):
            on = up.select(F.col("id").alias("to"), F.col("to").alias("next"))
            up = up.join(on, "to").select("id", F.col("next").alias("to"))
        up = stored(up, "pointers")
        if roots is None:
            roots = up.select("id", F.col("to").alias("root"))
        else:
            on = up.select(F.col("id").alias("root"), F.col("to").alias("next"))
            roots = roots.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        roots = stored(roots, "roots")
        for end in ("a", "b"):
            on = up.select(F.col("id").alias(end), F.col("to").alias("next"))
            edges = edges.join(on, end).drop(end).withColumnRenamed("next", end)
        edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
        for table in (*old, up):
            dropped(table)
    return roots if roots is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def prefix_pairs(nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, root, text) -> candidate pairs (a, b) of different roots, none missing that has the similarity.

    Shingles are ordered by how many of ``nodes`` hold them, so what is a text's own comes first and bounds what it can
    share.  A posting with one root gives no pair.  Two more bounds, both exact, hold pairs back before they are emitted:
    what can follow the first common shingle, and the parity marks of either set, which tell a lower bound of the
    shingles that only one of them has.  Texts of one id are sets of their own, and repeats of a set count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                sets = list(row_shingles(part.column(2), words))
                n = np.array([len(x) for x in sets])
                names = [np.array([set_hashes(x)[k] if len(x) else 0 for x in sets], np.int64) for k in range(2)]
                take = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take)), part.column(1).take(pa.array(take)), pa.array(signed(np.concatenate(sets)) if len(sets) else np.zeros(0, np.int64)), pa.array(np.repeat(n, n).astype(np.int64)), *(pa.array(np.repeat(x, n)) for x in names)], ["id", "root", "sh", "n", "s1", "s2"]
                )

    kind = dict(nodes.dtypes)["id"]
    cut = nodes.select("id", "root", "text").mapInArrow(run, f"id {kind}, root {kind}, sh long, n long, s1 long, s2 long")
    # a shingle held under one root only cannot pair two roots, but it counts in the order
    seen = cut.groupBy("sh").agg(F.count(F.lit(1)).alias("df"), (F.min("root") != F.max("root")).alias("several"))
    whole = cut.join(seen, "sh").groupBy("id", "root", "n", "s1", "s2").agg(F.sort_array(F.collect_set(F.struct("df", "sh", "several"))).alias("l"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    whole = whole.withColumns({f"m{w}": _parity(F.col("l.sh"), w) for w in range(MARKS)})
    marks = [f"m{w}" for w in range(MARKS)]
    post = whole.select("id", "root", "n", *marks, F.posexplode(F.slice("l", F.lit(1), first.cast("int"))).alias("i", "x")).where("x.several")
    post = post.select("id", "root", "n", *marks, (F.col("n") - F.col("i")).alias("rest"), F.col("x.sh").alias("sh"))
    x, y = post.alias("x"), post.alias("y")
    # at their first common shingle two sets can share no more than what follows it in either
    fits = F.least("x.rest", "y.rest") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    # a shingle in one set only flips one mark, so at least as many shingles differ as marks do
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in marks])
    close = differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    pairs = x.join(y, (F.col("x.sh") == F.col("y.sh")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.id") < F.col("y.id")) & fits & close)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _parity(shingles: Column, word: int) -> Column:
    """64 of the marks of a set: each shingle flips the one that its last bits name."""
    mine = F.filter(shingles, lambda s: F.shiftright(s, 6).bitwiseAND(F.lit(MARKS - 1)) == word)
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(mine, F.lit(0).cast("long"), lambda a, s: a.bitwiseXOR(bit(s)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id that it reaches, its own included), kept (it is that id).

    Null and empty texts, and those without a word, have no shingle and stand alone; so do rows with a null id (their
    component_id is null, and they are kept).  Rows that repeat an id count as one document: of one id the classes of
    all its texts are joined.  Ties go to the smallest id.  An empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    signs = stored(signed_rows(rows, words), "signatures")
    # one row and one text per shingle set, under the smallest id that has it; all joins below read these texts only
    least = F.min(F.struct("id", "text", "bands")).alias("m")
    sets = stored(signs.where("n_shingles > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(least).select("s1", "s2", F.col("m.id").alias("rep"), "m.text", "m.bands"), "sets")
    texts = sets.select(F.col("rep").alias("id"), "text")
    nodes = signs.select("id", "n_shingles", "s1", "s2").join(sets.select("s1", "s2", "rep"), ["s1", "s2"], "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"))
    nodes = stored(nodes, "nodes")

    buckets = sets.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket", apart(F.col("bucket"))).agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre <> last")
    members = stored(buckets.join(centres.select("bucket", "centre"), "bucket"), "buckets")
    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(confirmed(stars, texts, words, percent), "star-links")
    roots = components(links)

    # buckets that still hold several classes
    classed = members.select("id", "bucket").join(roots, "id", "left").select("id", "bucket", F.coalesce("root", "id").alias("root"))
    mixed = classed.groupBy("bucket", apart(F.col("bucket"))).agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y AND k > 2").select("bucket")
    open_ = classed.join(mixed, "bucket", "left_semi").select("id", "root").distinct()
    left = stored(texts.join(open_, "id"), "open")
    more = confirmed(prefix_pairs(left, words, percent), left.select("id", "text"), words, percent)
    # one id with several texts joins their classes
    ids = nodes.where("rep IS NOT NULL").select("id", "rep").distinct()
    first = ids.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")
    repeated = ids.join(first, "id").where("rep <> a").select("a", F.col("rep").alias("b"))
    more = stored(more.union(repeated), "more-links")
    found = components(links.union(more)) if more.take(1) else roots

    at = nodes.select("id", "n_shingles", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "id")
    return at.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def thinned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: of each class the one with the smallest id, all columns kept.  Ids name documents, so repeated ids stay together."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).where("NOT kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
