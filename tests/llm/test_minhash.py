import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rosterlight.llm import kernels, minhash


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    """id -> (n, smallest id reachable), by comparing every pair."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            i, j = rows[x][0], rows[y][0]
            if i is None or j is None or not sets[x] or not sets[y]:
                continue
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted((str(i), len(s), str(None if i is None else root(i))) for (i, _), s in zip(rows, sets, strict=True))


def found(spark, rows, k=4, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("bucket", F.lit("b"))
    got = minhash.near_duplicates(df, words=k, percent=percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def test_edges_and_edits_match_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one two"), (906, "two one"), (907, "a b c d e"), (908, "a b c d e"), (909, "a b c d e f"), (910, "x " * 3000), (911, "é è ü\xa0ß d e f g")]
    for base in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 40, 150, 600]))]
        for copy in range(8):
            edited = [rnd.choice(vocabulary) if rnd.random() < rnd.choice([0, 0.01, 0.03, 0.05]) else w for w in words]
            rows.append((base * 20 + copy, " ".join(edited)))
    rnd.shuffle(rows)
    assert found(spark, rows) == brute(rows, 4, 80)


def test_a_star_that_misses_a_link_is_made_good(spark):
    """The centre is unlike most; two others link only through a third that the star confirmed."""
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(10):
        copy = list(base)
        for j in range(3):
            copy[(k * 9 + j * 31) % 100] = f"x{k}{j}"
        rows.append((k, " ".join(copy)))
    rows.append((50, " ".join(base)))
    assert found(spark, rows) == brute(rows, 4, 80)


def test_repeated_ids_and_rows(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (7, "a b c d e f"), (6, "p q r s t u"), (6, "p q r s t u"), (9, "z z z z z z")]
    got = {(r[0], r[2]) for r in found(spark, rows)}
    assert got == {("5", "5"), ("6", "5"), ("7", "5"), ("9", "9")}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_densification_fills_every_bin_and_keeps_equal_sets_equal():
    for n in (1, 2, 7, 100, 5000):
        x = np.unique(kernels.mix(np.arange(n, dtype=np.uint64)))
        v = minhash.signature(x)
        assert np.isin(v, x).all()
        assert (v == minhash.signature(x.copy())).all()


def test_word_hashes_tell_texts_apart_and_ignore_neighbours():
    column = pa.array(["a b c d", None, "A B C D", "ab cd", "a b c d e", "", "a\x0bb\rc\td"])
    sets = [tuple(x) for x in kernels.row_shingles(column, 4)]
    assert sets[0] == sets[2] == sets[6] and len(sets[0]) == 1
    assert sets[1] == sets[5] == ()
    assert len(set(sets)) == 4 and set(sets[0]) < set(sets[4])


def test_thinned_keeps_one_of_each_class(spark):
    df = spark.createDataFrame([(3, "a b c d e f g"), (2, "a b c d e f g"), (4, None), (1, "other words stand in this one")], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.thinned(df).collect()) == [1, 2, 4]


def test_prefix_pairs_of_repeated_rows_and_of_texts_of_one_id(spark):
    """Two texts that differ early only: the repeats must not crowd the shared shingles out of a prefix."""
    base = [f"b{i}" for i in range(103)]
    near = [f"x{i}" for i in range(8)] + base[8:]
    other = [f"o{i}" for i in range(103)]
    one = [(1, 1, " ".join(base)), (1, 1, " ".join(other)), (2, 2, " ".join(near)), (3, 3, " ".join(other[:-2]))]
    for rows in (one, one[:1] * 12 + one[1:] * 2):
        got = minhash.prefix_pairs(spark.createDataFrame(rows, "id long, root long, text string"), 4, 80)
        assert {tuple(r) for r in got.collect()} >= {(1, 2), (1, 3)}


def test_repeated_rows_with_links_that_stars_miss_match_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for family in range(6):
        base = [f"f{family}b{i}" for i in range(100)]
        for k in range(8):
            copy = list(base)
            for j in range(3):
                copy[(k * 9 + j * 31) % 100] = f"f{family}x{k}{j}"
            rows += [(family * 100 + k, " ".join(copy))] * rnd.choice([1, 2, 9])
            rows += [(family * 100 + k, "  ".join(copy).upper())] * rnd.choice([0, 2])
    assert found(spark, rows) == brute(rows, 4, 80)


def test_a_family_just_under_the_threshold_gives_few_candidates(spark):
    """300 texts that are alike in 80 of 120 words and unlike in places of their own choice."""
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in range(120)]
        for k in rnd.sample(range(120), 10):
            words[k] = f"alt{k}"
        rows.append((i, i, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, root long, text string")
    got = {tuple(r) for r in minhash.prefix_pairs(df, 4, 80).collect()}
    sets = [shingle_set(t, 4) for *_, t in rows]
    links = {(i, j) for j in range(300) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links <= got and len(got) < 300 * 299 / 2 / 20


def test_marks_never_hide_a_link(spark):
    rnd = random.Random(4)
    rows = []
    for family in range(10):
        base = [f"f{family}w{k}" for k in range(rnd.choice([8, 60, 2500]))]
        for k in range(6):
            words = list(base)
            for j in rnd.sample(range(len(base)), rnd.randrange(1 + len(base) // 20)):
                words[j] = f"n{k}{j}"
            rows.append((family * 10 + k, family * 10 + k, " ".join(words)))
    got = {tuple(r) for r in minhash.prefix_pairs(spark.createDataFrame(rows, "id long, root long, text string"), 4, 80).collect()}
    sets = {i: shingle_set(t, 4) for i, _, t in rows}
    links = {(i, j) for j in sets for i in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(links) > 20 and links <= got
