import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rosterlight.llm import lm


def toks(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def corpus():
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(240):
        w, out = rnd.choice(common), []
        for _ in range(rnd.choice([0, 1, 5, 60])):
            out.append(w.upper() if rnd.random() < 0.1 else w)
            w = common[(common.index(w.lower() if w in common else common[0]) + rnd.choice([1, 1, 1, 2])) % 30] if rnd.random() < 0.9 else f"rare{rnd.randrange(500)}"
            w = w if w in common or w.startswith("rare") else common[0]
            if w.startswith("rare"):
                out.append(w)
                w = rnd.choice(common)
        rows.append((i, " \n".join(out)))
    return rows + [(240, None), (241, ""), (None, "c1 c2 c3"), (5, "c1 c2"), (5, "c1 c2"), (242, "é " * 5000)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("train", F.lit(1))
    k = F.coalesce(df["doc_id"], F.lit(0)) % 10
    return lm.scored(df, k != 0, k == 1).collect()


def test_counts_and_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_TOKENS", 500)
    rows = corpus()
    got = run(spark, rows)
    fold = lambda i: (i or 0) % 10
    learn = [toks(t) for i, t in rows if fold(i) != 0]
    kept = [toks(t) for i, t in rows if fold(i) > 1]
    count = lambda docs: (Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(["<s>", *d[:-1]], d, strict=True)), len(docs))
    one, two, n_docs = count(learn)
    n, v = sum(one.values()), len(one)
    k_one, k_two, k_docs = count(kept)
    k_n, k_v = sum(k_one.values()), len(k_one)
    cells = Counter()
    quarter = lambda p: int(np.clip(255 + np.round(4 * np.log2(p)), 1, 255)) if p > 0 else 0
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    for i, t in rows:
        if fold(i) == 1:
            d = toks(t)
            for u, w in zip(["<s>", *d[:-1]], d, strict=True):
                cu = k_docs if u == "<s>" else k_one[u]
                cells[(bucket(cu) * 256 + quarter(k_two[u, w] / max(cu, 1))) * 256 + quarter(k_one[w] / k_n)] += 1
    weights = lm.learned_weights(np.array(list(cells)), np.array(list(cells.values()), float), 1 / (k_v + 1))
    want = []
    for i, t in rows:
        d, base, score = toks(t), 0.0, 0.0
        for u, w in zip(["<s>", *d[:-1]], d, strict=True):
            cu = n_docs if u == "<s>" else one[u]
            a, b, g = weights[bucket(cu)]
            score += math.log10(a * two[u, w] / max(cu, 1) + b * one[w] / n + g / (v + 1))
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
        want.append((str(i), fold(i) != 0, len(d), sum(one[w] > 0 for w in d), n, round(base, 6), round(score, 6)))
    assert sorted((str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_bigrams_beat_the_base_on_held_out_texts(spark):
    got = [r for r in run(spark, corpus()) if not r.train and r.n_tokens > 20]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_weights_are_those_of_a_known_mixture():
    rng = np.random.default_rng(0)
    true = np.array([0.6, 0.3, 0.1])
    # three cells, each likely under one part only
    cell = np.array([(1 * 256 + 255) * 256 + 1, (1 * 256 + 0) * 256 + 255, (1 * 256 + 0) * 256 + 1])
    n = rng.multinomial(100_000, true).astype(float)
    w = lm.learned_weights(cell, n, 1e-9)[1]
    assert np.allclose(w, true, atol=0.01)


def test_no_training_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.scored(df, F.lit(False), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got] == [(0, 0, 0.0), (0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in got)
    assert lm.scored(df.limit(0), F.lit(True), F.lit(True)).count() == 0


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert (lm.unpacked_ints(lm.packed_ints(x), len(x)) == x).all()


def test_questions_stay_in_proportion_to_the_corpus():
    for gb in (1, 30, 1000, 20_000):
        tokens = gb * 10**9 // lm.TOKEN_BYTES
        size = lm.sized(gb * 10**9)
        assert lm.LEAST_TOKENS <= size <= lm.MOST_TOKENS
        assert (tokens / size) ** 2 <= tokens / lm.PER_QUESTION * 1.1
