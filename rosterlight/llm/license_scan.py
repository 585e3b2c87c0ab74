"""Licence scans by template markup.

A template is a licence's wording with regions marked as in the public licence-list templates: ``<<beginOptional>>`` ..
``<<endOptional>>`` may be left out, ``<<var;words=a-b>>`` stands for a to b words of any kind, and ``<<alt>>`` .. ``<<or>>``
.. ``<<endAlt>>`` is one of several wordings.  It is compiled into an automaton over words.  A text is accepted from a word
on when the automaton reaches its end, so all mandatory words must stand there, in order, and nothing else between.

Words are found and hashed for a batch at once; automata start only where a template's first two words stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, chained, slices, span_hashes, text_buffers, word_spans

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

# The phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wordings of public licences and notices, with their regions marked.
TEMPLATES = (
    ("mit", "<<alt>>released<<or>>licensed<<or>>distributed<<or>>available<<endAlt>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>>"
        " shall be included in all copies or substantial portions of the software",
    ),
    ("apache-2", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use <<alt>>this file<<or>>this work<<or>>these files<<endAlt>> except in compliance with the license"
        " you may obtain a copy of the license at <<var;words=3-8>> unless required by applicable law or agreed to in writing software"
        " distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    ("gpl-3", "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<alt>>3<<or>>v3<<endAlt>> <<beginOptional>>or <<alt>>later<<or>>any later version<<endAlt>><<endOptional>>"),
    (
        "gpl-3",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or <<beginOptional>>at your option<<endOptional>> any later version",
    ),
    ("gpl-2", "licensed under the gnu general public license <<beginOptional>>version<<endOptional>> <<alt>>2<<or>>v2<<endAlt>> <<beginOptional>>or <<alt>>later<<or>>any later version<<endAlt>><<endOptional>>"),
    (
        "gpl-2",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license <<alt>>version 2 as published by the free software foundation"
        "<<or>>as published by the free software foundation <<alt>>version 2 of the license<<or>>either version 2 of the license or <<beginOptional>>at your option<<endOptional>> any later version<<endAlt>><<endAlt>>",
    ),
    (
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu <<alt>>lesser<<or>>library<<endAlt>> general public license as published by the free software foundation"
        " either version <<alt>>2<<or>>2 1<<or>>3<<endAlt>> of the license or <<beginOptional>>at your option<<endOptional>> any later version",
    ),
    ("lgpl", "licensed under the gnu <<alt>>lesser<<or>>library<<endAlt>> general public license <<beginOptional>><<beginOptional>>version<<endOptional>> <<alt>>2<<or>>2 1<<or>>v2 1<<or>>3<<or>>v3<<endAlt>><<endOptional>>"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license <<alt>>v<<or>>version<<endAlt>> 2 0 if a copy of the mpl was not distributed with this file"
        " you can obtain one at <<var;words=3-8>>",
    ),
    ("mpl-2", "licensed under the mozilla public license <<beginOptional>>version<<endOptional>> <<alt>>2<<or>>v2<<endAlt>> <<beginOptional>>0<<endOptional>>"),
    (
        "cc-by-sa",
        "licensed under <<beginOptional>><<alt>>a<<or>>the<<endAlt>><<endOptional>> <<alt>>cc by sa<<or>>creative commons attribution sharealike<<or>>creative commons attribution share alike<<endAlt>>"
        " <<beginOptional>><<alt>>4<<or>>3<<or>>2<<endAlt>> <<alt>>0<<or>>5<<endAlt>> <<beginOptional>><<alt>>international<<or>>unported<<endAlt>><<endOptional>><<endOptional>>",
    ),
    (
        "cc-by-nc",
        "licensed under <<beginOptional>><<alt>>a<<or>>the<<endAlt>><<endOptional>> <<alt>>cc by nc<<or>>creative commons attribution noncommercial<<or>>creative commons attribution non commercial<<endAlt>>"
        " <<beginOptional>><<alt>>4<<or>>3<<or>>2<<endAlt>> <<alt>>0<<or>>5<<endAlt>><<endOptional>>",
    ),
    (
        "cc-by",
        "licensed under <<beginOptional>><<alt>>a<<or>>the<<endAlt>><<endOptional>> <<alt>>cc by<<or>>creative commons attribution<<endAlt>> <<alt>>4<<or>>3<<or>>2<<endAlt>> <<alt>>0<<or>>5<<endAlt>>"
        " <<beginOptional>><<alt>>international<<or>>unported<<endAlt>><<endOptional>>",
    ),
    ("cc0", "<<alt>>licensed<<or>>released<<endAlt>> under <<beginOptional>>the<<endOptional>> <<alt>>cc0<<or>>creative commons zero<<endAlt>> <<beginOptional>>1 0 <<beginOptional>>universal<<endOptional>><<endOptional>>"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsd", "<<alt>>licensed<<or>>released<<endAlt>> under the <<beginOptional>><<alt>>2<<or>>3<<or>>simplified<<or>>new<<or>>modified<<endAlt>> <<beginOptional>>clause<<endOptional>><<endOptional>> bsd <<beginOptional>><<alt>>2<<or>>3<<endAlt>> clause<<endOptional>> license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " <<var;words=0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " <<var;words=0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        "permission to use copy modify and <<alt>>or<<or>><<endAlt>> distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies",
    ),
)

_MARK = re.compile(r"<<[^>]*>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY = -1


def words_of(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hashes_of(words: list[str]) -> list[int]:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends).tolist() if raw else []


@dataclass
class Automaton:
    """States with free moves and moves on a word (a hash, or ``ANY``); the start is 0."""

    label: str
    free: list[list[int]] = field(default_factory=lambda: [[]])
    moves: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    end: int = 0

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def step(self, states: set[int], word: int) -> set[int]:
        return self.closed({t for s in states for w, t in self.moves[s] if w in (ANY, word)})

    def longest(self, words: list[int], at: int) -> int:
        """How many words it accepts from ``at`` on, at most; 0 if none."""
        states, best = self.closed({0}), 0
        for n in range(at, len(words)):
            states = self.step(states, words[n])
            if not states:
                break
            if self.end in states:
                best = n - at + 1
        return best

    def openings(self) -> tuple[set[tuple[int, int]], set[int]]:
        """The pairs of first words it can start with, and first words that may be followed by any or by the end."""
        pairs, alone = set(), set()
        for s in self.closed({0}):
            for w, t in self.moves[s]:
                then = self.closed({t})
                seconds = {v for u in then for v, _ in self.moves[u]}
                if self.end in then or ANY in seconds:
                    alone.add(w)
                pairs |= {(w, v) for v in seconds if v != ANY}
        return pairs, alone


def compiled(label: str, markup: str) -> Automaton:
    """The automaton of one template; unbalanced or unknown marks, and templates that accept nothing or start with any word, are errors."""
    a = Automaton(label)
    at, stack = 0, []
    for piece in _MARK.findall(markup):
        if piece == "<<beginOptional>>":
            stack.append(("o", at, None))
        elif piece == "<<endOptional>>":
            kind, start, _ = stack.pop()
            if kind != "o":
                raise ValueError(f"{piece} without its beginning")
            a.free[start].append(at)
        elif piece == "<<alt>>":
            stack.append(("a", at, a.state()))
            at = a.state()
            a.free[stack[-1][1]].append(at)
        elif piece in ("<<or>>", "<<endAlt>>"):
            kind, start, end = stack[-1]
            if kind != "a":
                raise ValueError(f"{piece} outside <<alt>>")
            a.free[at].append(end)
            if piece == "<<or>>":
                at = a.state()
                a.free[start].append(at)
            else:
                stack.pop()
                at = end
        elif m := re.fullmatch(r"<<var;words=(\d+)-(\d+)>>", piece):
            end = a.state()
            for k in range(int(m[2])):
                if k >= int(m[1]):
                    a.free[at].append(end)
                new = a.state()
                a.moves[at].append((ANY, new))
                at = new
            a.free[at].append(end)
            at = end
        elif piece.startswith("<<"):
            raise ValueError(f"unknown mark {piece}")
        else:
            new = a.state()
            a.moves[at].append((hashes_of([piece])[0], new))
            at = new
    a.end = at
    if stack or a.end in a.closed({0}) or ANY in a.openings()[1] or any(w == ANY for w, _ in a.openings()[0]):
        raise ValueError(f"template of {label}: unbalanced, empty, or open at its beginning")
    return a


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...]):
        self.phrases = [(np.array(hashes_of(words_of(p)), np.uint64), label) for p, label in phrases.items()]
        self.automata = [compiled(label, markup) for label, markup in templates]
        self.openings = []
        for a in self.automata:
            pairs, alone = a.openings()
            two = np.array([[x for x, _ in pairs], [y for _, y in pairs]], np.uint64).reshape(2, -1)
            self.openings.append((chained([two[0], two[1]]), np.array(sorted(alone), np.uint64)))

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
        """Per row: the number of words, and the (first word, words, label) of base phrases and of accepted templates."""
        data, at = text_buffers(column)
        data = LOWER[data]
        for low, high in slices(at):
            starts, ends, n = word_spans(data, at[low : high + 1], WORD)
            h = span_hashes(data, starts, ends)
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(high - low), n)
            base: dict[int, list] = {}
            for words, label in self.phrases:
                k, m = len(words), len(h) - len(words) + 1
                if m <= 0:
                    continue
                hit = row[:m] == row[k - 1 :]
                for i in range(k):
                    hit &= h[i : i + m] == words[i]
                for p in np.flatnonzero(hit).tolist():
                    base.setdefault(int(row[p]), []).append((p - int(first[row[p]]), k, label))
            more: dict[int, list] = {}
            two = chained([h[:-1], h[1:]]) if len(h) > 1 else h[:0]
            for a, (pairs, alone) in zip(self.automata, self.openings, strict=True):
                places = np.flatnonzero(np.isin(two, pairs))
                if len(alone):
                    places = np.union1d(places, np.flatnonzero(np.isin(h, alone)))
                for p in places.tolist():
                    r = int(row[p])
                    begin, stop = int(first[r]), int(first[r] + n[r])
                    if k := a.longest(h[p:stop].tolist() if stop - p < 4096 else _Lazy(h, p, stop), 0):
                        more.setdefault(r, []).append((p - begin, k, a.label))
            for r in range(high - low):
                yield int(n[r]), base.get(r, []), more.get(r, [])


class _Lazy:
    """A long rest of a text as a list of words."""

    def __init__(self, h: np.ndarray, start: int, stop: int):
        self.h, self.start, self.stop = h, start, stop

    def __len__(self) -> int:
        return self.stop - self.start

    def __getitem__(self, i: int) -> int:
        return int(self.h[self.start + i])




def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per row: id, n_words, base and templates (arrays of structs first_word, words, label).

    A null text is an empty one: no words, no matches.  Repeated rows give repeated results.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(PHRASES, templates)
        as_dict = lambda s: [dict(zip(("first_word", "words", "label"), x, strict=True)) for x in s]
        for b in batches:
            got = list(scanner.scan(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([as_dict(x[1]) for x in got], span), pa.array([as_dict(x[2]) for x in got], span)], ["id", "n_words", "base", "templates"])

    struct = "array<struct<first_word:long,words:long,label:string>>"
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, base {struct}, templates {struct}").withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the share of words inside any match)."""
    s = scanned(docs, id_col, text_col)
    names = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    starts = F.col("base.first_word")
    spans = F.sort_array(F.concat("base", "templates"))
    # overlapping matches count once: walk the sorted spans with (words so far, end so far)
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["first_word"] + x["words"] - F.greatest(x["first_word"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["first_word"] + x["words"]).alias("end"),
        ),
    )["n"]
    return s.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(F.col("base.label")).alias("base_labels"),
        names(F.concat("base.label", "templates.label")).alias("labels"),
        F.when(F.size(spans) > 0, walk / F.col("n_words")).otherwise(0.0).alias("score"),
    )
