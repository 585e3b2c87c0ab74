"""Language-model scores by deleted interpolation over word bigrams.

p(w | u) = a_b * c(u, w) / c(u) + b_b * c(w) / N + g_b / (V + 1), where b is the octave of the context's frequency c(u).
The weights of each octave are learned by expectation-maximisation: a tenth of the training documents is deleted from the
counts, and the weights that make those held-out tokens likeliest are found.  Scores use the counts of all training documents.

Counts are exact and nothing is cut off, so what is gathered grows with the corpus.  To keep that in bounds, documents
travel in blocks of some megabytes, written once.  A block asks for the counts of its distinct n-grams by sorted keys,
split by key range; the task of a range adds up what all blocks hold and answers each block in the order it asked.
An n-gram that a third of all texts share is so sent once per block, and a text is moved once, to meet its answers.
Keys are 64-bit hashes: of D different n-grams about D^2 / 2^65 pairs share one, so 10^8 words leave 0.0003 such pairs
and 10^12 bigrams about 27,000; a pair that does is counted as one n-gram.

A block asks every key range, so questions are blocks times ranges.  Both sizes grow with the square root of the corpus
(``sized``), so that the number of questions stays in proportion to it: no more than one for every ``PER_QUESTION`` tokens,
up to the size where a block reaches ``MOST_TOKENS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .kernels import LOWER, SPACE, chained, mix, span_hashes, text_buffers, word_spans

LEAST_TOKENS = 1 << 20  # of a block and of a key range
MOST_TOKENS = 16 << 20  # what one task holds in memory, about 80 bytes a token
PER_QUESTION = 64
TOKEN_BYTES = 6
MOST_TASKS = 20_000
END = np.uint64(0xC2B2AE3D27D4EB4F)
START = np.uint64(0x165667B19E3779F9)
OCTAVES = 64
ROUNDS = 200
_QUARTERS = 256  # cells of a quarter octave per probability; 0: it is zero


def packed_ints(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes: high bytes that are all zero cost nothing."""
    planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def unpacked_ints(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def sized(total_bytes: int) -> int:
    """Tokens of a block, and of a key range, for a corpus of so many bytes."""
    return min(MOST_TOKENS, max(LEAST_TOKENS, math.isqrt(PER_QUESTION * total_bytes // TOKEN_BYTES)))


def blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(id, train, deleted, text) -> one row per block: block, deleted, ids, train, sizes, bytes, tokens, text (compressed).

    A block holds documents of one side of the deletion; a text longer than a block has a block of its own.
    """
    kind = rows.select("id").schema[0].dataType.simpleString()
    arrow = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flushed(side: bool) -> pa.RecordBatch:
            nonlocal number
            some, held[side], size[side], number = held[side], [], 0, number + 1
            text = b"".join(x[2] for x in some)
            data, at = np.frombuffer(text, np.uint8), np.cumsum([0, *(len(x[2]) for x in some)])
            n = len(word_spans(data, at, ~SPACE)[0]) + len(some)
            ids = pa.array([x[0] for x in some], type=id_type[0])
            columns = [pa.array([number]), pa.array([side]), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids), pa.array([[x[1] for x in some]]), pa.array([[len(x[2]) for x in some]], pa.list_(pa.int64())), pa.array([n]), pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, arrow.names)

        id_type = [pa.int64()]
        for b in batches:
            id_type[0] = b.schema.field(0).type
            data, at = text_buffers(b.column(3))
            ids, train, deleted = (b.column(i).to_pylist() for i in range(3))
            for i in range(b.num_rows):
                side = deleted[i]
                if held[side] and size[side] + at[i + 1] - at[i] > block_bytes:
                    yield flushed(side)
                held[side].append((ids[i], train[i], LOWER[data[at[i] : at[i + 1]]].tobytes()))
                size[side] += int(at[i + 1] - at[i])
        for side in (False, True):
            if held[side]:
                yield flushed(side)

    return rows.select("id", "train", "deleted", "text").mapInArrow(run, f"block long, deleted boolean, ids array<{kind}>, train array<boolean>, sizes array<long>, tokens long, text binary")


class Block:
    """The tokens of one block and their n-gram keys."""

    def __init__(self, text: bytes, sizes: np.ndarray):
        total = int(sizes.sum())
        data = np.frombuffer(pa.decompress(text, total, "zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
        starts, ends, n = word_spans(data, np.r_[0, np.cumsum(sizes)], ~SPACE)
        self.n = n + 1  # with its end, by document
        self.doc = np.repeat(np.arange(len(sizes)), self.n)
        token = np.full(len(self.doc), END, np.uint64)
        token[np.arange(len(starts)) + np.repeat(np.arange(len(sizes)), n)] = span_hashes(data, starts, ends)
        self.heads = np.cumsum(self.n) - self.n
        context = np.r_[START, token[:-1]] if len(token) else token
        context[self.heads] = START
        self.keys = (mix(token ^ np.uint64(0x27D4EB2F165667C5)), chained([context, token]))

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.keys[kind], return_inverse=True)

    def counts(self, answers: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(u), c(w) and c(u, w) of each token; ``answers``: for unigrams and bigrams the counts by sorted distinct key."""
        one, two = (np.concatenate(a)[self.distinct(kind)[1]].astype(np.int64) for kind, a in enumerate(answers))
        context = np.r_[0, one[:-1]]
        context[self.heads] = one[self.heads + self.n - 1]  # as many starts as ends
        return context, one, two


def _asked(table: DataFrame, ranges: int) -> DataFrame:
    """block, deleted, part, n, keys, counts: what each block asks of each key range of either kind of n-gram."""
    arrow = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("part", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    low = 64 - (ranges.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = Block(r["text"], np.array(r["sizes"], np.int64))
                train = np.repeat(np.array(r["train"], bool), x.n)
                out = []
                for kind in (0, 1):
                    keys, at = x.distinct(kind)
                    count = np.bincount(at, train, len(keys)).astype(np.uint64)
                    part = (keys >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        steps = np.diff(keys[i:j], prepend=np.uint64(0))
                        steps[0] = keys[i]
                        out.append({"block": r["block"], "deleted": r["deleted"], "part": kind * ranges + int(part[i]), "n": j - i, "keys": packed_ints(steps), "counts": packed_ints(count[i:j])})
                yield pa.RecordBatch.from_pylist(out, arrow)

    return table.select("block", "deleted", "train", "sizes", "text").mapInArrow(run, "block long, deleted boolean, part long, n long, keys binary, counts binary")


def _answered(asked: DataFrame, ranges: int) -> DataFrame:
    """block, part, n, all, kept: for each question the counts over all training documents and, for deleted blocks, without the deleted.

    Of each unigram range one more row, of block -1, has in ``sums`` the distinct tokens and tokens: all, then kept.
    """
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("all", pa.binary()), ("kept", pa.binary()), ("sums", pa.list_(pa.int64()))])

    def group(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = np.concatenate([np.cumsum(unpacked_ints(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([unpacked_ints(r["counts"], r["n"]) for r in rows]).astype(np.float64)
        gone = np.repeat([r["deleted"] for r in rows], [r["n"] for r in rows])
        _, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts).astype(np.uint64)
        kept = total - np.bincount(at, counts * gone).astype(np.uint64)
        out, i = [], 0
        for r in rows:
            own = at[i : i + r["n"]]
            out.append({"block": r["block"], "part": r["part"], "n": r["n"], "all": packed_ints(total[own]), "kept": packed_ints(kept[own]) if r["deleted"] else None, "sums": None})
            i += r["n"]
        if rows[0]["part"] < ranges:
            out.append({"block": -1, "part": rows[0]["part"], "n": 0, "all": None, "kept": None, "sums": [int(x) for c in (total, kept) for x in ((c > 0).sum(), c.sum())]})
        return pa.Table.from_pylist(out, schema)

    # a range of either kind has its own task (or turn by turn with others): a hash of so few numbers would heap some of them up
    tasks = min(2 * ranges, MOST_TASKS)
    dealt = asked.withColumn("slot", F.pmod("part", F.lit(tasks)).cast("int")).repartitionById(tasks, "slot")
    return dealt.groupBy("slot", "part").applyInArrow(group, "block long, part long, n long, all binary, kept binary, sums array<bigint>")


def _with_answers(table: DataFrame, answers: DataFrame, which: str) -> DataFrame:
    got = answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "n", F.col(which).alias("c")))).alias("answers"))
    return table.join(got, "block")


def _answers(raw: list[dict], ranges: int) -> list[list[np.ndarray]]:
    out: list[list[np.ndarray]] = [[], []]
    for x in raw:
        out[x["part"] >= ranges].append(unpacked_ints(x["c"], x["n"]))
    return out


def octave(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the binary logarithm of their frequency."""
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def ratios(context: np.ndarray, one: np.ndarray, two: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return two / np.maximum(context, 1), one / max(n, 1)


def _cells(held: DataFrame, ranges: int, n: int) -> DataFrame:
    """cell, n: how many deleted tokens have which context octave and, to a quarter octave, which two likelihoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quarter = lambda p: np.where(p > 0, np.clip(_QUARTERS - 1 + np.round(4 * np.log2(np.maximum(p, 1e-300))), 1, _QUARTERS - 1), 0).astype(np.int64)
        for b in batches:
            for r in b.to_pylist():
                context, one, two = Block(r["text"], np.array(r["sizes"], np.int64)).counts(_answers(r["answers"], ranges))
                p2, p1 = ratios(context, one, two, n)
                cell, k = np.unique((octave(context) * _QUARTERS + quarter(p2)) * _QUARTERS + quarter(p1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(k.astype(np.int64))], ["cell", "n"])

    return held.select("sizes", "text", "answers").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learned_weights(cell: np.ndarray, n: np.ndarray, rest: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of bigram, unigram and uniform likelihood by octave, by expectation-maximisation over the cells.

    Octaves without a held-out token have those of the nearest lower octave that has any.
    """
    back = lambda q: np.where(q > 0, 2.0 ** ((q - (_QUARTERS - 1)) / 4), 0.0)
    which = cell // (_QUARTERS * _QUARTERS)
    p = np.stack([back(cell // _QUARTERS % _QUARTERS), back(cell % _QUARTERS), np.full(len(cell), rest)], 1)
    weights = np.full((OCTAVES + 1, 3), 1 / 3)
    weights[0] = 0, 0.9, 0.1
    for _ in range(rounds):
        share = weights[which] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        total = np.stack([np.bincount(which, share[:, k], OCTAVES + 1) for k in range(3)], 1)
        seen = total.sum(1) > 0
        weights[seen] = np.maximum(total[seen] / total[seen].sum(1, keepdims=True), [0, 1e-9, 1e-6])
        weights[0, 0] = 0
        weights /= weights.sum(1, keepdims=True)
    found = np.bincount(which, n, OCTAVES + 1) > 0
    for k in range(2, OCTAVES + 1):
        if not found[k]:
            weights[k] = weights[k - 1]
    return weights


def scored(docs: DataFrame, train: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, train, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    ``train`` says which rows are learned from, ``deleted`` which of these are held out for the weights.  A null or empty
    text is its end alone (one token).  Repeated rows count and are scored each.  Without a training row all tokens are
    unknown and N is 0; an empty table gives an empty one.
    """
    train = F.coalesce(train, F.lit(False))
    rows = docs.select(docs[id_col].alias("id"), train.alias("train"), (train & F.coalesce(deleted, F.lit(False))).alias("deleted"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = sized(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    table = stored(blocks(rows, size * TOKEN_BYTES), "lm-blocks")
    tokens = table.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    ranges = 1 << max(0, math.ceil(math.log2(max(1, tokens) / size)))
    answers = stored(_answered(_asked(table, ranges), ranges), "lm-counts")
    sums = answers.where("block < 0").agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(4)]).first()
    v, n, v_kept, n_kept = sums

    held = _with_answers(table.where("deleted"), answers.where("kept IS NOT NULL"), "kept")
    cells = _cells(held, ranges, n_kept).collect()  # at most octaves * quarters^2 rows, whatever the corpus
    weights = learned_weights(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], float), 1 / (v_kept + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                r = part.drop_columns(["ids"]).to_pylist()[0]
                x = Block(r["text"], np.array(r["sizes"], np.int64))
                context, one, two = x.counts(_answers(r["answers"], ranges))
                p2, p1 = ratios(context, one, two, n)
                w = weights[octave(context)]
                model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
                base = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
                add = lambda y, x=x: np.bincount(x.doc, y, len(x.n))
                ids = part.column("ids").flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(r["train"], pa.bool_()), pa.array(x.n.astype(np.int64)), pa.array(add(one > 0).astype(np.int64)), pa.array(np.full(len(ids), n)), pa.array(add(base)), pa.array(add(model))],
                    ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = rows.select("id").schema[0].dataType.simpleString()
    whole = _with_answers(table, answers, "all").select("ids", "train", "sizes", "text", "answers")
    return whole.mapInArrow(run, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
