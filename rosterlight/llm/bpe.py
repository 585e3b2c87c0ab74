"""Byte-pair encoding and decoding with a public byte-level vocabulary.

Short words are merged in a contiguous rank array: a matrix row holds a word's parts and, beside it, the rank of each
adjacent pair; every step finds each row's minimum, deletes one boundary and looks up the two neighbouring ranks again.
All words that a batch of documents meets for the first time go through the matrix together.  Words over ``SHORT`` bytes
take a heap over the same pairs, so that a long run of letters costs n log n rather than n squared.

A text is cut at its spaces and line feeds first.  Where no two white-space characters stand together, no pre-token
crosses such a cut, so the ids of a piece depend on the piece alone and are remembered.  Other texts, and those that
spell a special token, are cut by the pattern.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import making_room

# The published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT = 48
REMEMBERED = 600_000
FEW = 48
NEVER = 2**31 - 1
_NONE = np.int32(NEVER)


def byte_letters() -> dict[str, int]:
    """The published letter of each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON, byte level, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.names = [str(i) for i in range(size)]
        self.bytes_of = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in word) if word not in special else word.encode()
        for word, i in special.items():
            self.bytes_of[i] = word.encode()
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.shift = np.int64(size)
        keys = left * self.shift + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.result = made  # by rank
        self._table()
        self.pairs = None  # of ints, for single words
        self.byte_list, self.result_list = self.byte_ids.tolist(), self.result.tolist()
        self.find = regex.compile(PATTERN).findall
        self.doubled = regex.compile(r"\s\s").search
        self.head: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.n_head: dict[str, int] = {}
        self.n_spaced: dict[str, int] = {}
        self.pretokens: dict[str, bytes] = {}  # of texts that are cut by the pattern

    def _table(self) -> None:
        """Open addressing of the pairs, so that a look-up is two or three gathers."""
        bits = int(len(self.keys) * 4).bit_length()
        self.mask = np.int64((1 << bits) - 1)
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        left, probe = np.arange(len(self.keys)), 0
        self.probes = 0
        while len(left):
            at = (self._slot(self.keys[left]) + probe) & self.mask
            free = self.slot_key[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]] = self.keys[left[put]], self.ranks[left[put]]
            left, probe = left[~put], probe + 1
        self.probes = probe

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or a very large number."""
        keys = left * self.shift + right
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (self._slot(keys[open_]) + probe) & self.mask
            found = self.slot_key[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of at most ``SHORT`` bytes, all at once."""
        if len(words) < FEW:
            return [self.merge_one(w) for w in words]
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for block in np.array_split(order, max(1, len(order) // 4096)):
            self._merge_block(words, sizes, block, out)
        return out

    def _merge_block(self, words: list[bytes], sizes: np.ndarray, block: np.ndarray, out: list[bytes]) -> None:
        if not len(block):
            return
        n = sizes[block].copy()
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        parts = np.full((len(block), width + 1), -1, np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in block), np.uint8)
        parts[:, :width][inside] = self.byte_ids[flat]
        ranks = np.full((len(block), width + 1), _NONE, np.int32)
        for j in range(width - 1):
            has = np.flatnonzero(n > j + 1)
            ranks[has, j] = self.rank(parts[has, j], parts[has, j + 1])
        live = np.arange(len(block))
        while len(live):
            p, r = parts[live], ranks[live]
            at = r.argmin(1)  # the leftmost of the lowest
            rows = np.arange(len(live))
            lowest = r[rows, at]
            go = lowest < _NONE
            live, p, r, at, lowest = live[go], p[go], r[go], at[go], lowest[go]
            if not len(live):
                break
            rows = np.arange(len(live))
            p[rows, at] = self.result[lowest]
            # delete the boundary after `at`
            take = np.arange(width + 1) + (np.arange(width + 1) > at[:, None])
            take[take > width] = width
            p, r = np.take_along_axis(p, take, 1), np.take_along_axis(r, take, 1)
            p[:, width] = -1
            n[live] -= 1
            # refresh the ranks on both sides
            right = p[rows, np.minimum(at + 1, width)]
            r[rows, at] = np.where(right >= 0, self.rank(p[rows, at], np.maximum(right, 0)), _NONE)
            prev = np.flatnonzero(at > 0)
            r[prev, at[prev] - 1] = self.rank(p[prev, at[prev] - 1], p[prev, at[prev]])
            parts[live], ranks[live] = p, r
        flat, step = parts[:, :width].astype(np.uint32).tobytes(), 4 * width
        for i, at, k in zip(block.tolist(), range(0, len(flat), step), (4 * n).tolist(), strict=True):
            out[i] = flat[at : at + k]

    def merge_one(self, word: bytes) -> bytes:
        """The ids of one short word by the same steps on two lists, for batches too small for a matrix."""
        parts, shift, get = [self.byte_list[b] for b in word], int(self.shift), self._pairs().get
        ranks = [get(a * shift + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest == NEVER:
                break
            i = ranks.index(lowest)
            parts[i : i + 2] = [self.result_list[lowest]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] * shift + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] * shift + parts[i], NEVER)
        return np.array(parts, np.uint32).tobytes()

    def _pairs(self) -> dict[int, int]:
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self.pairs

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word by a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, shift, get = len(ids), int(self.shift), self._pairs().get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * shift + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.result[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := get(ids[i] * shift + ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (r := get(ids[before[i]] * shift + ids[i])) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], ids[i]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as the bytes of unsigned 32-bit numbers."""
        raw = [w.encode("utf-8") for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        out: list[bytes] = [b""] * len(raw)
        for i, ids in zip(short, self.merge_short([raw[i] for i in short]), strict=True):
            out[i] = ids
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                out[i] = self.merge_long(w).tobytes()
        return out

    def _learn(self, known: dict[str, bytes], lead: str, pieces: set[str]) -> None:
        if not pieces:
            return
        letters = [p for p in pieces if p.isalpha()]  # one pre-token each
        known.update(zip(letters, self.words([lead + p for p in letters]), strict=True))
        todo = list(pieces.difference(letters))
        cut = [self.find(lead + p) for p in todo]
        fresh = list({w for c in cut for w in c})
        ids = dict(zip(fresh, self.words(fresh), strict=True))
        known.update((p, b"".join([ids[w] for w in c])) for p, c in zip(todo, cut, strict=True))

    def _plain(self, text: str) -> bool:
        return self.doubled(text) is None and not (self.split_special and "<|" in text and self.split_special.search(text))

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, special tokens recognised."""
        for first in range(0, len(texts), 512):
            some = texts[first : first + 512]
            if len(self.head) + len(self.spaced) > REMEMBERED:
                self.head.clear()
                self.spaced.clear()
            cut = [[line.split(" ") for line in t.split("\n")] if self._plain(t) else None for t in some]
            heads: set[str] = set()
            spaced: set[str] = set()
            for c in cut:
                for line in c or ():
                    heads.add(line[0])
                    spaced.update(line[1:])
            self._learn(self.head, "", {p for p in heads if p not in self.head})
            self._learn(self.spaced, " ", {p for p in spaced if p not in self.spaced})
            head, get, feed = self.head, self.spaced.__getitem__, np.uint32(self.byte_ids[10]).tobytes()
            for t, c in zip(some, cut, strict=True):
                ids = self._by_pattern(t) if c is None else feed.join([b"".join([head[line[0]], *map(get, line[1:])]) for line in c])
                yield np.frombuffer(ids, np.uint32)

    def count_batch(self, texts: list[str]) -> list[int]:
        """The number of ids of each text: the sums over the remembered pieces, without putting the ids together."""
        out: list[int] = []
        for first in range(0, len(texts), 1 << 14):
            some = texts[first : first + (1 << 14)]
            if len(self.n_head) + len(self.n_spaced) > REMEMBERED:
                self.n_head.clear()
                self.n_spaced.clear()
            cut = [[line.split(" ") for line in t.split("\n")] if self._plain(t) else None for t in some]
            heads = {line[0] for c in cut for line in c or ()}
            spaced: set[str] = set()
            for c in cut:
                for line in c or ():
                    spaced.update(line[1:])
            for known, lead, pieces in ((self.n_head, "", heads), (self.n_spaced, " ", spaced)):
                fresh: dict[str, bytes] = {}
                self._learn(fresh, lead, pieces.difference(known))
                known.update((p, len(ids) // 4) for p, ids in fresh.items())
            head, get = self.n_head, self.n_spaced.__getitem__
            for t, c in zip(some, cut, strict=True):
                out.append(len(self._by_pattern(t)) // 4 if c is None else len(c) - 1 + sum([head[line[0]] + sum(map(get, line[1:])) for line in c]))
        return out

    def _by_pattern(self, text: str) -> bytes:
        out = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
                continue
            cut = self.find(part)
            if len(self.pretokens) > REMEMBERED // 4:
                self.pretokens.clear()
            fresh = [w for w in set(cut) if w not in self.pretokens]
            self.pretokens.update(zip(fresh, self.words(fresh), strict=True))
            out.extend(map(self.pretokens.__getitem__, cut))
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder per Python worker; its memory of pieces serves the worker's later tasks."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, n_tokens: every text (null: empty) encoded; repeated rows stay rows, an empty text has no ids."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = list(bpe.encode_batch(part.column(1).to_pylist()))
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), values), pa.array(np.diff(at).astype(np.int64))], ["id", "ids", "n_tokens"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ids replaced by its text column; null ids give an empty text, an id outside the vocabulary is an error.

    A column of ``tokens`` named text comes out as text_.  An empty table gives an empty one.
    """
    tokens = making_room(tokens, "text") if ids_col.lower() != "text" else tokens
    rest = [c for c in tokens.columns if c != ids_col]
    rows = tokens.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("ids_"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "ids_") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                column = part.column(part.num_columns - 1)
                values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = [bpe.decode(values[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*rest, "text"])

    return rows.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, the ids never leaving the worker.

    Null text: empty (no ids; both digests are those of the empty text).
    """
    import hashlib

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        name = bpe.names.__getitem__
        for b in batches:
            n, a, d = [], [], []
            for i in range(0, b.num_rows, 512):
                for ids in bpe.encode_batch(b.column(1).slice(i, 512).to_pylist()):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(name, ids.tolist())).encode()).hexdigest())
                    d.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
