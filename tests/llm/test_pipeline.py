import random

from pyspark.sql import functions as F

import corpus_pipeline
from rosterlight.llm import queries
from tests.llm.test_minhash import brute
from tests.llm.test_quality import brute as counts

SYLLABLES = {"en": ["the", "ing", "er", "ion", "and", "wh"], "de": ["sch", "ung", "keit", "ver", "ein", "ü"]}


def text(rnd, lang, lines=6):
    word = lambda: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(2, 5)))
    return "\n".join(" ".join(word() for _ in range(15)).capitalize() + "." for _ in range(lines))


def corpus():
    rnd = random.Random(12)
    rows = [(i, text(rnd, lang), lang, "src0" if i % 3 else "src1", 0) for i, lang in enumerate(["en", "de"] * 30)]
    base = rows[4][1]
    rows += [(100, base, "en", "a", 1), (101, base, "en", "b", 1), (101, base, "en", "b", 1)]  # copies, one row twice
    words = base.split(" ")
    words[40] = "changed"
    rows += [(102, " ".join(words), "en", "c", 1)]  # near copy
    rows += [(200, None, "en", "x", None), (201, "", None, None, None), (202, "too short", "en", "x", 9), (203, "Home | about | news | shop | cart | help | login | join | more | terms | end", "en", "x", 1), (204, " ".join(["1234567 98765."] * 3 + [str(i * 7919) + "." for i in range(40)]), "en", "x", 1)]
    rows += [(300, rows[7][1] + "\nAccept all cookies", "de", "y", 1)]  # a copy once cleaned
    rows += [(None, text(rnd, "en"), "en", "z", 1), (400, text(rnd, "en", 900), None, "z", 1)]
    return rows


def test_stages_keep_what_brute_force_keeps(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = docs.collect()
    clean = {r.doc_id for r in seen["quality"]}
    assert clean == {r[0] for r in rows if not counts(r[1])[-1]} - {203}
    assert {r.doc_id for r in seen["language"]} == clean - {204}
    texts = {}
    for r in seen["language"]:
        texts.setdefault(r.text, []).append(r.doc_id)
    assert len(seen["exact"]) == len(texts)
    assert {r.doc_id for r in seen["exact"]} == {min((i for i in ids if i is not None), default=None) for ids in texts.values()}
    assert {4, 7} <= {r.doc_id for r in seen["exact"]} and not {100, 101, 300} & {r.doc_id for r in seen["exact"]}
    roots = brute([(r.doc_id, r.text) for r in seen["exact"]], corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert sorted(str(r.doc_id) for r in seen["near"]) == sorted(i for i, _, root in roots if i == root)
    assert 102 not in {r.doc_id for r in seen["near"]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen["near"]}
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_own_columns_named_like_those_of_a_stage_keep_their_values(spark):
    rnd = random.Random(3)
    rows = [(i, text(rnd, lang), lang, f"own {i}", float(i), i % 2 == 0) for i, lang in enumerate(["en", "de"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, pred__ string, score__ double, rejected__ boolean")
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns and out.count() > 20
    assert all((r.pred__, r.score__, r.rejected__) == (f"own {r.doc_id}", float(r.doc_id), r.doc_id % 2 == 0) for r in out.collect())


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}


def test_queries_cover_their_whole_tables(spark):
    for name in ("op2_bpe", "op3_license_scan", "op5_token_counts", "op10_lm_score"):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
        assert (got.n, got.ids) == (200, 200), name
