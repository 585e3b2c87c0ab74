import hashlib
import math

import duckdb
import numpy as np
import pytest

from rosterlight.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Plain loops: (id, code, error, label_error) of every usable row, and the digest."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    w = len(kept[0][1]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, x, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, near, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [math.floor(sum(v[j] for v in own) / len(own)) if sum(v[j] for v in own) < 2**50 else None for j in range(w)]
    near = assign()
    errors = [sum(dist(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, near, strict=True)]
    label = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        label[g] = label.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(v) for p in books for z in p for v in z).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for e in a), err, label[g]) for (i, _, g), a, err in zip(kept, near, errors, strict=True)), digest


def compare(spark, rows, parts, entries, rounds, tasks=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(tasks)
    got = vector_codes.report(df, parts=parts, entries=entries, rounds=rounds).collect()
    want, digest = brute(rows, parts, entries, rounds)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_equals_plain_loops_with_copies_nulls_and_bad_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=8).astype(np.float32)], [None, 1, 2][i % 3]) for i in range(230)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(80)] + [(3, rows[3][1], 1), (None, rows[5][1], None)]
    rows += [(-1, None, 1), (-2, [None] * 8, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, None), (-5, [], 2)]
    compare(spark, rows, parts=4, entries=16, rounds=2)


@pytest.mark.parametrize("seed", range(3))
def test_ties_go_to_the_lower_entry(spark, seed):
    """Few distinct values: many points lie as near to one entry as to another, and entries coincide."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(c) / 256 for c in rng.integers(-2, 3, 6)], int(rng.integers(0, 2))) for i in rng.permutation(300)]
    compare(spark, rows, parts=3, entries=12, rounds=3)


def test_fewer_rows_than_entries_and_one_row(spark):
    compare(spark, [(5, [0.1, 0.2, -0.3, 0.4], 1), (4, [0.5, -0.25, 0.0, 1.0], None), (4, [0.5, -0.25, 0.0, 0.5], None)], parts=2, entries=64, rounds=2)
    compare(spark, [(5, [0.1, 0.2], None)], parts=2, entries=64, rounds=2)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100, 1000])
@pytest.mark.parametrize("spread", [3, 400])
def test_filtering_finds_the_nearest_entry_of_every_point(n, spread):
    rng = np.random.default_rng(n + spread)
    points, book = rng.integers(-spread, spread, (n, 4)), rng.integers(-spread, spread, (20, 4))
    sums, counts = np.zeros((20, 4), np.int64), np.zeros(20, np.int64)
    near = np.full(n, -1)
    for at, tree in vector_codes.forest(points):
        near[at + tree.order] = vector_codes.filtered(tree, book, sums, counts)
    want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (near == want).all()
    assert (counts == np.bincount(want, minlength=20)).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(20))


def test_whole_subtrees_are_assigned_without_looking_at_points():
    """Four far groups and an entry at each: every group is assigned by nodes above the leaves."""
    rng = np.random.default_rng(0)
    centres = np.array([[-3000, 0], [-1000, 0], [1000, 0], [3000, 0]])
    points = np.repeat(centres, 256, axis=0) + rng.integers(-20, 21, (1024, 2))
    tree = vector_codes.Tree(points, 7)
    tree.points = np.full_like(tree.points, 10**6)  # reading a point would show
    sums, counts = np.zeros((4, 2), np.int64), np.zeros(4, np.int64)
    near = vector_codes.filtered(tree, centres, sums, counts)
    assert (near == np.repeat(np.arange(4), 256)[tree.order]).all() and counts.tolist() == [256] * 4
    assert all((sums[e] == points[256 * e : 256 * e + 256].sum(0)).all() for e in range(4))


def test_empty_tables_and_errors(spark):
    assert vector_codes.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.report(spark.createDataFrame([(1, None, 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.report(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA))


def test_clashing_columns(spark):
    rows = [(i, [i / 10, 1.0 - i / 7], i % 2, "x", 9, 8) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA + ", code string, error int, v int")
    got = vector_codes.report(df, parts=2, entries=4).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == brute([r[:3] for r in rows], 2, 4, 2)[0]


def test_registered_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_vector_codes"](spark, folder)
    want = duckdb.sql(f"WITH embeddings AS (FROM '{folder}/embeddings.parquet') SELECT {', '.join(got.columns)} FROM ({queries.SQL['op12_vector_codes']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
