"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are cut into pieces of at most one sequence; full pieces need no packing.  The others are dealt by a hash into
blocks of some thousand, and each block is evolved on several islands, one task row each.  An island starts from packings
by best fit in random orders, which waste some bins; crossover injects whole well-filled bins of one parent into the other,
drops the bins that would hold a document twice, swaps displaced documents for smaller ones where that fills a bin better,
and best-fits what is left in order of size.  After an epoch every island sends its elite to the next one of its block.  Plain best fit in order of size is computed as a yardstick
only: an island that needs more bins than it goes on for longer.
Documents of the badly filled bins of all blocks are pooled and packed again, so that blocks leave no ragged ends.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import stored

CAPACITY = 4096
END_ID = 1
BLOCK_DOCS = 4000
ISLANDS = 2
POPULATION = 6
OFFSPRING = 6
GENERATIONS = 40
EPOCHS = 2
ELITE = 2  # packings of an island that go to the next one
INJECTED = (0.1, 0.5)  # share of the bins that a crossover injects
SPREAD = 0.02  # of the capacity: a bin emptier by so much is drawn e times less often
SWAPPED = 150  # bins in which a crossover tries to replace documents
EMPTIED = 0.1  # at most this share of the emptiest bins is dissolved with them
WELL_FILLED = 0.985  # of the capacity: bins that the second round leaves alone
MOST_TASKS = 10_000
REMEMBERED = 500_000
MEMBERS = 10  # documents of a bin that it looks at for that
#: By number of documents: the indexes of all sets of two and of three of them.
_SUBSETS = [[np.array(list(combinations(range(m), k)), np.int64).reshape(-1, k) for k in (2, 3)] for m in range(MEMBERS + 1)]


# Texts of these characters alone, without two stops together, may be lower-cased whole and cut at stops and commas as at blanks.
_STOPS = ".,"
_PLAIN = frozenset(c for c in map(chr, range(256)) if c.isalpha() or c.isascii() and c.isdigit() or c in " \t\n\r" + _STOPS)
# Blanks that other engines cut differently.
_ODD = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r")


def _chunks(text: str) -> list[str] | None:
    """The chunks of a text that can be encoded apart; None if it must be encoded whole."""
    letters = set(text)
    if letters <= _PLAIN and not any(a + b in text for a in _STOPS for b in _STOPS):
        return text.lower().replace(".", " . ").replace(",", " , ").split()
    return None if letters & _ODD or "<|" in text else text.split()


class WordTokens(dict):
    """A ``tokenizers`` vocabulary whose pre-tokens never hold white space: a chunk between blanks -> the bytes of its ids.

    A chunk is encoded when it is first asked for, and remembered.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.tokenize = self.model.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.stop = {p: self._raw(p) for p in (".", ",")}

    def _raw(self, text: str) -> bytes:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """Words of Latin letters are one pre-token, which the vocabulary's model takes as it is, in lower case and without a
        full stop or comma behind, as the vocabulary's own rules treat them."""
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            ids = array("I", [t.id for t in self.tokenize(chunk)]).tobytes()
        else:
            core, stop = (chunk[:-1], chunk[-1]) if chunk[-1] in self.stop else (chunk, "")
            if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
                word = core.lower()
                if word == chunk:  # letters beyond ASCII, spelt in the vocabulary's letters for bytes
                    ids = array("I", [t.id for t in self.tokenize("".join([self.letters[b] for b in word.encode()]))]).tobytes()
                else:
                    ids = self[word] + self.stop[stop] if stop else self[word]
            else:
                ids = self._raw(chunk)
        self[chunk] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as the bytes of unsigned 32-bit numbers."""
        get = self.__getitem__
        for t in texts:
            if len(self) > REMEMBERED:
                self.clear()
            chunks = _chunks(t)
            yield self._raw(t) if chunks is None else b"".join(map(get, chunks))


_LOADED: dict[str, WordTokens] = {}


def loaded(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): each text (null: empty) as its ids and the end id, cut where longer than ``capacity``."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end, step = np.uint32(END_ID).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                of, piece, length, crc, ids = [], [], [], [], []
                for k, raw in enumerate(tokens.encode_batch(part.column(1).to_pylist())):
                    raw += end
                    for p in range(0, len(raw), step):
                        x = raw[p : p + step]
                        of.append(k)
                        piece.append(p // step)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            ids.append(np.frombuffer(x, np.uint32).astype(np.int32))
                columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(order: np.ndarray, sizes: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Puts the items of ``order``, in that order, each into the fullest bin with room, or a new one; changes ``bins`` and ``loads``.

    Bins stand in stacks by their room; a bit mask of the stacks in use names the smallest room that is large enough.
    """
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, load in enumerate(loads):
        if load < capacity:
            stacks.setdefault(capacity - load, []).append(b)
    for room in stacks:
        mask |= 1 << room
    for i in order.tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
            loads[b] += size
        else:
            b, room = len(loads), capacity
            loads.append(size)
        bins[i] = b
        if left := room - size:
            stacks.setdefault(left, []).append(b)
            mask |= 1 << left


def seeded(sizes: np.ndarray, capacity: int, rng: np.random.Generator, kind: int = 0) -> np.ndarray:
    """A packing to start from: best fit in random order, which leaves room for crossover to find.

    So that packings differ in more than luck, ``kind`` 1 takes the documents over half a sequence first, and kind 2 an
    order of size blurred by half of each size; both are random otherwise.
    """
    n = len(sizes)
    order = rng.permutation(n)
    if kind % 3 == 1:
        order = order[np.argsort(2 * sizes[order] <= capacity, kind="stable")]
    elif kind % 3 == 2:
        order = np.argsort(-sizes * (1 + 0.5 * rng.standard_normal(n)), kind="stable")
    bins = np.full(n, -1, np.int64)
    best_fit(order, sizes, bins, [], capacity)
    return bins


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> int:
    """The number of bins of plain best fit in order of size: a yardstick, never a packing that is returned."""
    bins = np.full(len(sizes), -1, np.int64)
    loads: list[int] = []
    best_fit(np.argsort(-sizes, kind="stable"), sizes, bins, loads, capacity)
    return len(loads)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of their fill; smaller is better."""
    loads = np.bincount(bins, sizes)
    return len(loads), -float(((loads / capacity) ** 2).sum())


def _numbered(bins: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, int]:
    """The bins of ``part`` numbered from 0 without gaps, and how many there are."""
    used = np.zeros(int(bins.max()) + 1, bool)
    used[bins[part]] = True
    return (np.cumsum(used) - 1)[bins[part]], int(used.sum())


def replaced(child: np.ndarray, sizes: np.ndarray, loads: np.ndarray, capacity: int, rng: np.random.Generator) -> None:
    """Swaps one to three documents of a bin for one displaced, larger one that fills it better; changes ``child`` and ``loads``.

    Displaced documents (bin -1) thereby grow smaller, and are easier to place.  Of ``SWAPPED`` bins with room, drawn at
    random, each makes the swap that fills it most; where several want the same document the first gets it, and the others
    choose again.
    """
    open_ = rng.permutation(np.flatnonzero(loads < capacity))[:SWAPPED]
    by_bin = np.argsort(child, kind="stable")
    heads = np.searchsorted(child[by_bin], np.r_[open_, open_ + 1]).reshape(2, -1)
    count = np.minimum(heads[1] - heads[0], MEMBERS)
    # the members of each bin, from a random one on where there are more than are looked at
    first = heads[0] + (rng.random(len(open_)) * (heads[1] - heads[0] - count + 1)).astype(np.int64)
    free = np.flatnonzero(child < 0)
    free = free[np.argsort(sizes[free], kind="stable")]
    for m in np.unique(count[count > 0]).tolist():
        which = np.flatnonzero(count == m)
        own = by_bin[first[which][:, None] + np.arange(m)]
        w = sizes[own]
        out = np.concatenate([w, *(w[:, x].sum(2) for x in _SUBSETS[m])], axis=1)
        limit = out + (capacity - loads[open_[which]])[:, None]
        left = np.arange(len(which))
        while len(left) and len(free):
            small = sizes[free]
            at = np.searchsorted(small, limit[left], side="right") - 1
            won = np.where(at >= 0, small[np.maximum(at, 0)], 0) - out[left]
            k = won.argmax(1)
            rows = np.arange(len(left))
            good = won[rows, k] > 0
            left, k, want, won = left[good], k[good], at[rows, k][good], won[rows, k][good]
            _, mine = np.unique(want, return_index=True)
            for i in mine.tolist():
                b, members = open_[which[left[i]]], own[left[i]]
                gone = members[k[i]] if k[i] < m else members[_SUBSETS[m][0][k[i] - m]] if k[i] < m + len(_SUBSETS[m][0]) else members[_SUBSETS[m][1][k[i] - m - len(_SUBSETS[m][0])]]
                child[free[want[i]]] = b
                child[gone] = -1
                loads[b] += won[i]
            free = np.delete(free, want[mine])
            left = np.delete(left, mine)


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with some well-filled bins of ``b`` whole.

    Bins of ``b`` are drawn by how well they fill, full ones most often.  Bins of ``a`` that hold an injected document go,
    as do a few of the emptiest.  Documents displaced with them first replace smaller ones where that fills a bin better;
    the rest is put back by best fit in order of size.
    """
    loads_b = np.bincount(b, sizes)
    few = max(1, int(len(loads_b) * rng.uniform(*INJECTED)))
    chance = np.exp((loads_b - capacity) / (SPREAD * capacity))
    taken = np.zeros(len(loads_b), bool)
    # the largest of log(uniform) / weight: a weighted draw without repeats
    taken[np.argpartition(np.log(rng.random(len(loads_b))) / chance, -few)[-few:]] = True
    injected = taken[b]
    loads = np.bincount(a, sizes)
    hit = np.zeros(len(loads), bool)
    hit[a[injected]] = True
    hit[np.argsort(loads, kind="stable")[: 1 + int(len(loads) * rng.uniform(0, EMPTIED))]] = True
    stays = ~hit[a] & ~injected
    child = np.full(len(a), -1, np.int64)
    child[stays], k = _numbered(a, stays)
    child[injected], more = _numbered(b, injected)
    child[injected] += k
    placed = child >= 0
    filled = np.bincount(child[placed], sizes[placed], k + more).astype(np.int64)
    replaced(child, sizes, filled, capacity, rng)
    rest = np.flatnonzero(child < 0)
    best_fit(rest[np.argsort(-sizes[rest], kind="stable")], sizes, child, filled.tolist(), capacity)
    return child


def evolved(sizes: np.ndarray, capacity: int, seed: int, people: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION, offspring: int = OFFSPRING, target: int = 0) -> tuple[list[np.ndarray], int, int]:
    """One island after some generations: its packings, best first, the bins of its best at the start, and the crossovers run.

    ``people`` are packings to go on from; missing ones are seeded.  A generation adds ``offspring`` children of random
    parents, then the best ``population`` live on.  It ends early where no packing can have fewer bins, and goes on for
    four times as many generations while it needs more than ``target`` bins.
    """
    rng = np.random.default_rng(seed)
    people = [*people, *(seeded(sizes, capacity, rng, kind) for kind in range(population - len(people)))]
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    first, born = scored[0][0][0], 0
    least = math.ceil(sizes.sum() / capacity)
    for g in range(4 * generations):
        if scored[0][0][0] <= (least if g < generations else target or least):
            break
        if g >= generations and not target:
            break
        for _ in range(offspring):
            i, j = rng.choice(len(scored), 2, replace=False)
            child = crossed(scored[i][2], scored[j][2], sizes, capacity, rng)
            scored.append((fitness(child, sizes, capacity), len(people) + born, child))
            born += 1
            if scored[-1][0][0] <= least:
                break
        scored = sorted(scored, key=lambda x: x[:2])[:population]
    return [p for _, _, p in scored], first, born


def _islands(items: DataFrame, n: int, capacity: int, block_docs: int) -> DataFrame:
    """(rid, length) of ``n`` rows -> the evolved islands: block, island, rids, sizes, people (best first), bins, and their figures.

    The figures: bound (the total length allows no fewer bins), best_fit (bins of plain best fit in order of size),
    started (bins of the best seed) and crossovers.
    """
    blocks = max(1, math.ceil(n / block_docs))
    held = items.groupBy(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("x"))
    none = F.array().cast("array<array<int>>")
    zero = F.lit(0).cast("long")
    state = held.select(
        "block", F.col("x.rid").alias("rids"), F.col("x.length").alias("sizes"), F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), none.alias("people"), none.alias("guests"),
        zero.alias("best_fit"), zero.alias("started"), zero.alias("crossovers"),
    )
    state = state.repartition(min(MOST_TASKS, max(1, blocks * ISLANDS // 2)), "block", "island")
    finished = None
    own = ["block", "island", "rids", "sizes", "people", "bins", "bound", "best_fit", "started", "crossovers"]

    for epoch in range(EPOCHS):

        def run(parts: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                done = []
                for r in pdf.itertuples():
                    sizes = np.asarray(r.sizes, np.int64)
                    least = math.ceil(sizes.sum() / capacity)
                    best_fit = int(r.best_fit) or best_fit_decreasing(sizes, capacity)
                    before = [np.asarray(p, np.int64) for g in (r.guests, r.people) for p in g][:POPULATION]
                    people, first, born = evolved(sizes, capacity, hash((int(r.block), int(r.island), epoch)) & 0xFFFFFFFF, before, target=best_fit)
                    done.append(([p.astype(np.int32) for p in people], int(people[0].max()) + 1, least, best_fit, int(r.started) or first, int(r.crossovers) + born))
                people, bins, bound, best_fit, started, crossovers = zip(*done, strict=True) if done else [[]] * 6
                yield pdf.assign(people=list(people), bins=list(bins), bound=list(bound), best_fit=list(best_fit), started=list(started), crossovers=list(crossovers))[own]

        state = stored(
            state.mapInPandas(run, "block long, island int, rids array<bigint>, sizes array<bigint>, people array<array<int>>, bins long, bound long, best_fit long, started long, crossovers long"), "islands"
        )
        if epoch + 1 < EPOCHS:
            # blocks of which no island has proved its packing best go on; the best of each island go to the next one
            open_ = state.groupBy("block").agg(F.min(F.col("bins") - F.col("bound")).alias("over")).where("over > 0").select("block")
            rest = state.join(open_, "block", "left_anti")
            finished = rest if finished is None else finished.unionByName(rest)
            state = state.join(open_, "block", "left_semi")
            sent = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("people", 1, ELITE).alias("guests"))
            state = state.drop("bins", "bound").join(sent, ["block", "island"]).repartition(min(MOST_TASKS, max(1, blocks * ISLANDS // 2)), "block", "island")
    return state if finished is None else state.unionByName(finished)


def _best(islands: DataFrame) -> DataFrame:
    """Of each block the island with the fewest bins."""
    best = islands.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("m")).select("block", F.col("m.island").alias("island"))
    return islands.join(best, ["block", "island"])


def _round(items: DataFrame, n: int, capacity: int, first: int, block_docs: int) -> DataFrame:
    """(rid, length) of ``n`` rows -> rid, sequence_id, offset, fill, packed block by block."""

    def laid(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                bins, sizes = np.asarray(r.own, np.int64), np.asarray(r.sizes, np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                heads = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
                offset = np.empty(len(bins), np.int64)
                offset[order] = before - np.repeat(before[heads], np.diff(np.r_[heads, len(bins)]))
                yield pd.DataFrame({"rid": np.asarray(r.rids, np.int64), "length": sizes, "sequence_id": ((int(r.block) * 2 + first) << 20) + bins, "offset": offset, "fill": np.bincount(bins, sizes)[bins].astype(np.int64)})

    won = _best(_islands(items, n, capacity, block_docs)).select("block", "rids", "sizes", F.get("people", F.lit(0)).alias("own"))
    return won.mapInPandas(laid, "rid long, length long, sequence_id long, offset long, fill long")


def evolution_figures(parts: DataFrame, capacity: int = CAPACITY, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per block of the first round: block, documents, bound, best_fit, started, bins and crossovers (of all its islands)."""
    table = stored(parts.where(F.col("length") < capacity).select(F.monotonically_increasing_id().alias("rid"), "length"), "pieces")
    islands = _islands(table, table.count(), capacity, block_docs)
    return islands.groupBy("block").agg(
        F.max(F.size("rids")).alias("documents"), F.max("bound").alias("bound"), F.max("best_fit").alias("best_fit"), F.min("started").alias("started"), F.min("bins").alias("bins"), F.sum("crossovers").alias("crossovers")
    )


def packed(parts: DataFrame, capacity: int = CAPACITY, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``parts`` (with a length column, 1 to ``capacity``) with sequence_id and offset: gapless places in as few sequences as found.

    Every row is a document of its own, repeated ones too.  The numbers mean nothing; an empty table gives an empty one.
    """
    table = stored(parts.withColumn("rid", F.monotonically_increasing_id()), "pieces")  # written, so a row's number stays
    loose = table.where(F.col("length") < capacity).select("rid", "length")
    first = stored(_round(loose, loose.count(), capacity, 0, block_docs), "packed")
    rest = first.where(F.col("fill") < WELL_FILLED * capacity).select("rid", "length")
    again = _round(rest, rest.count(), capacity, 1, block_docs)
    places = first.where(F.col("fill") >= WELL_FILLED * capacity).unionByName(again).select("rid", "sequence_id", "offset")
    alone = table.where(F.col("length") >= capacity).select("*", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return table.join(places, "rid").unionByName(alone).drop("rid")


def report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces(docs, vocabulary, id_col, text_col)).withColumnRenamed("id", id_col)
