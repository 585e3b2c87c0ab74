"""Token counts that follow edits: each document keeps a segment tree over runs of pre-tokens.

A leaf is a run of pre-tokens between two safe cuts: a space with no white space on either side, where a pre-token begins
whatever stands elsewhere.  A node holds the characters and tokens below it.  An edit finds its leaves by going down the
character sums; only these are encoded again, with the filled leaf on a side where the edit spoils the safe cut (the boundary
context), and the sums on their paths to the root are updated.  The sums are kept with the leaves, so a later call goes on where the last one ended;
only an edit that changes the number of leaves builds the sums of its document anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, loaded

LEAF_CHARS = 128
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_HEAD = regex.compile(r" \S").match  # of every filled leaf but the first; each ends in no white space, but the last may
_BLANK = regex.compile(r"\s").match


def leaves_of(text: str, least: int = LEAF_CHARS) -> list[str]:
    """``text`` in runs of at least ``least`` characters, cut at safe places only; an empty text has one empty leaf."""
    out, start = [], 0
    while (m := _CUT.search(text, start + least)) is not None:
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class Tree:
    """Sums of characters and tokens over leaves, in heap order: node k has the children 2k and 2k + 1, the leaves stand last."""

    def __init__(self, leaves: list[str], chars: list[int], tokens: list[int]):
        self.leaves, self.chars, self.tokens = leaves, chars, tokens
        self.width = len(tokens) // 2
        self.encoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last filled one for the end of the text) and the place in it."""
        k = 1
        while k < self.width:
            k *= 2
            if at > self.chars[k] or at == self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.width, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.width
        chars, count = len(text) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += count
            k //= 2

    def cut(self, at: int, remove: int, insert: str) -> tuple[int, int, bool, list[str]]:
        """What an edit has to encode: the first and last leaf that it touches, whether their number changes, and the new leaves.

        The edit removes characters at a place and inserts a text there; places beyond the text count as its end.
        """
        at = min(max(at, 0), self.chars[1])
        remove = min(max(remove, 0), self.chars[1] - at)
        first, inside = self.find(at)
        last = self.find(at + remove)[0] if remove else first
        middle = "".join(self.leaves[first : last + 1])
        new = middle[:inside] + insert + middle[inside + remove :]
        # the boundary context: where the edit spoils the safe cut to the next filled leaf, that leaf is encoded with it
        before = next((k for k in range(first - 1, -1, -1) if self.leaves[k]), None)
        if before is not None and new and not _HEAD(new):
            new, first = "".join(self.leaves[before:first]) + new, before
        after = next((k for k in range(last + 1, len(self.leaves)) if self.leaves[k]), None)
        if after is not None and new and _BLANK(new[-1]):
            new, last = new + "".join(self.leaves[last + 1 : after + 1]), after
        room = last - first + 1
        parts = leaves_of(new, max(LEAF_CHARS, len(new) // room))
        if len(parts) > room or len(new) > 8 * LEAF_CHARS * room:
            return first, last, True, leaves_of(new)
        return first, last, False, parts

    def put(self, first: int, last: int, rebuild: bool, parts: list[str], counts: list[int]) -> None:
        """The leaves of ``cut`` with their tokens: sums change on the paths above them, or, where their number changed, everywhere."""
        self.encoded += len(parts)
        if rebuild:
            held = self.tokens[self.width : self.width + len(self.leaves)]
            self.leaves[first : last + 1] = parts
            self.width, self.chars, self.tokens = sums(list(map(len, self.leaves)), held[:first] + counts + held[last + 1 :])
            return
        for k in range(last - first + 1):
            text, n = (parts[k], counts[k]) if k < len(parts) else ("", 0)
            if text or self.leaves[first + k]:
                self._set(first + k, text, n)


def sums(chars: list[int], tokens: list[int]) -> tuple[int, list[int], list[int]]:
    """The width of a tree over these leaves, and its two heaps (their first entry is unused)."""
    width = 1 << max(0, len(chars) - 1).bit_length()
    out = []
    for leaf in (chars, tokens):
        levels = [leaf + [0] * (width - len(leaf))]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([a + b for a, b in zip(below[::2], below[1::2], strict=True)])
        out.append([0, *(x for level in reversed(levels) for x in level)])
    return width, *out


_STATE = "leaves array<string>, chars array<int>, tokens array<int>"


def _lists(column: pa.Array) -> list[list]:
    """A list column as Python lists: its values are turned at once and then cut."""
    flat, at = column.flatten().to_pylist(), np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()]).tolist()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _column(lists: list[list], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array([x for y in lists for x in y], kind))


def _columns(own: list[Tree]) -> list[pa.Array]:
    return [_column([t.leaves for t in own], pa.string()), _column([t.chars for t in own], pa.int32()), _column([t.tokens for t in own], pa.int32())]


def trees_of(texts: list[str], bpe: Bpe) -> list[Tree]:
    """The trees of some texts, their leaves encoded together."""
    cut = [leaves_of(t) for t in texts]
    n = iter(bpe.count_batch([x for c in cut for x in c]))
    return [Tree(c, *sums(list(map(len, c)), [next(n) for _ in c])[1:]) for c in cut]


def apply_edits(own: list[Tree], edits: list[list[dict | None] | None], bpe: Bpe) -> list[list[int]]:
    """Edits the trees, the k-th edits of all encoded together; tokens before, tokens after, leaves before and leaves encoded."""
    todo = [[e for e in x or () if e is not None] for x in edits]
    before, leaves = [t.total for t in own], [len(t.leaves) for t in own]
    for k in range(max(map(len, todo), default=0)):
        open_ = [(t, t.cut(e[k]["place"] or 0, e[k]["remove"] or 0, e[k]["insert"] or "")) for t, e in zip(own, todo, strict=True) if k < len(e)]
        counts = iter(bpe.count_batch([p for _, c in open_ for p in c[3]]))
        for t, c in open_:
            t.put(*c, [next(counts) for _ in c[3]])
    return [before, [t.total for t in own], leaves, [t.encoded for t in own]]


_FIGURES = ("n_before", "n_tokens", "n_leaves", "n_encoded")


def _edits() -> Column:
    return F.transform("edits", lambda e: F.struct(e["place"].cast("long").alias("place"), e["remove"].cast("long").alias("remove"), e["insert"].alias("insert"))).alias("edits")


def trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, leaves array<string>, chars and tokens array<int>: each document's tree, leaves and heaps.  A null text is an empty one.

    Other columns play no part; an empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(trees_of(part.column(1).to_pylist(), bpe))], ["id", "leaves", "chars", "tokens"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {_STATE}").withColumnRenamed("id", id_col)


def with_edits(state: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``state`` with its edits (id, seq, place, remove, insert) as an array in order of seq.

    Edits of one document follow upon each other, so they meet in one task; those of unknown or null ids are dropped.
    """
    own = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "place", "remove", "insert"))).alias("edits"))
    return state.join(own, id_col, "left")


def edited(state: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """``state`` (id, leaves, chars, tokens, edits) after its edits: the same, and n_before, n_tokens, n_leaves, n_encoded.

    The k-th edits of a batch of documents are encoded together.  n_encoded counts the leaves that were encoded again.
    Null edits and null fields of an edit (0 and the empty text) change nothing; places beyond a text are its end.
    Repeated rows are edited each.
    """
    kind = dict(state.dtypes)[id_col]
    rows = state.select(F.col(id_col).alias("id"), "leaves", "chars", "tokens", _edits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                own = [Tree(*x) for x in zip(*(_lists(part.column(c)) for c in (1, 2, 3)), strict=True)]
                numbers = apply_edits(own, part.column(4).to_pylist(), bpe)
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(own), *(pa.array(x, pa.int64()) for x in numbers)], ["id", "leaves", "chars", "tokens", *_FIGURES])

    return rows.mapInArrow(run, f"id {kind}, {_STATE}, " + ", ".join(f"{c} long" for c in _FIGURES)).withColumnRenamed("id", id_col)


def edited_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` (id, text, edits): id, n_before, n_tokens, n_leaves, n_encoded.

    ``trees`` and ``edited`` in one pass for documents whose trees are not kept: they never leave the worker, and its
    memory of pieces serves the edits too.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), _edits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                numbers = apply_edits(trees_of(part.column(1).to_pylist(), bpe), part.column(2).to_pylist(), bpe)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in numbers)], ["id", *_FIGURES])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} long" for c in _FIGURES)).withColumnRenamed("id", id_col)
