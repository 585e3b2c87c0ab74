import re

import pytest
from pyspark.sql import functions as F

from rosterlight.llm import license_scan as ls

MIT = next(t for label, t in ls.TEMPLATES if label == "mit" and "hereby" in t)
ROWS = [
    (1, "Some work. Released under the MIT License. More words follow here."),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "Licensed under CC BY-NC 4.0. And again: cc by nc!"),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "Not under the mit of license; apache license version 3"),
    (6, None),
    (6, ""),
    (7, "under the MIT-License under the MIT license undér the mit license"),
    (8, re.sub("<<[^>]*>>", "", MIT).upper()),
    (9, re.sub("<<[^>]*>>", "", MIT).replace("without restriction", "with restriction")),
    (10, "x " * 30000 + "released under the mit license"),
    (None, "cc by nc"),
]


def brute(t):
    w = ls.words_of(t or "")
    places = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force_and_labels_add_to_it(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("n_words", F.lit(2))
    got = ls.report(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(i, *brute(t)) for i, t in ROWS], key=key)
    labels = {r.doc_id: r.labels for r in got}
    assert labels == {1: "mit", 2: "apache-2", 3: "cc-by-nc", 4: "gpl-3", 5: "", 6: "", 7: "mit", 8: "mit", 9: "", 10: "mit", None: "cc-by-nc"}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[8] == 1.0
    assert ls.report(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "n"),
    [("a b c d", 4), ("a c d", 3), ("a b d", 0), ("a c x d", 0), ("a c x y z end", 0), ("a c e f g", 5), ("a c e f", 0), ("a b c e q r s g", 0)],
)
def test_optional_alternative_and_replaceable_regions(text, n):
    a = ls.compiled("x", "a <<beginOptional>>b<<endOptional>> c <<alt>>d<<or>>e <<var;words=1-2>> g<<endAlt>>")
    assert a.longest(ls.hashes_of(text.split()), 0) == n


def test_malformed_templates_are_errors():
    for bad in ("<<beginOptional>> a", "a <<endAlt>>", "<<beginOptional>>a<<endOptional>>", "<<var;words=1-2>> a", "a <<huh>>"):
        with pytest.raises((ValueError, IndexError)):
            ls.compiled("x", bad)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
        ("It is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl-2"),
        ("It is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.", "lgpl"),
        ("Licensed under the GNU Lesser General Public License v3.", "lgpl"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2"),
        ("Text is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("licensed under the Creative Commons Attribution-NonCommercial 4.0 licence", "cc-by-nc"),
        ("Released under CC0 1.0 Universal", "cc0"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Licensed under the 3-Clause BSD License", "bsd"),
        ("Licensed under the GNU Affero something", ""),
        ("free software under the terms of the GNU Lesser General Public License", ""),
    ],
)
def test_wordings_with_their_regions_are_accepted(text, label):
    import pyarrow as pa

    scanner = ls.Scanner(ls.PHRASES, ls.TEMPLATES)
    (_, _, found), *_ = list(scanner.scan(pa.array(["x " + text + " y"])))
    assert {x for _, _, x in found} == ({label} if label else set())


def test_empty_table(spark):
    assert ls.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
