import hashlib

import pytest
from pyspark.sql import functions as F

from rosterlight.llm import exact_dedup

# a published pair of different texts with one md5
A = bytes.fromhex("d131dd02c5e6eec4693d9a0698aff95c2fcab58712467eab4004583eb8fb7f8955ad340609f4b30283e488832571415a085125e8f7cdc99fd91dbdf280373c5bd8823e3156348f5bae6dacd436c919c6dd53e2b487da03fd02396306d248cda0e99f33420f577ee8ce54b67080a80d1ec69821bcb6a8839396f9652b6ff72a70")
B = bytes.fromhex("d131dd02c5e6eec4693d9a0698aff95c2fcab50712467eab4004583eb8fb7f8955ad340609f4b30283e4888325f1415a085125e8f7cdc99fd91dbd7280373c5bd8823e3156348f5bae6dacd436c919c6dd53e23487da03fd02396306d248cda0e99f33420f577ee8ce54b67080280d1ec69821bcb6a8839396f965ab6ff72a70")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("sha", F.lit("s"))


def test_groups_nulls_ties_and_case(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (None, "a"), (None, "z"), (6, "a "), (7, "é")])
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(df, stays="largest").collect())
    assert got == sorted(
        [("1", "2", 4, False), ("2", "2", 4, True), ("2", "2", 4, True), ("None", "2", 4, False), ("3", "3", 1, True), ("4", "5", 2, False), ("5", "5", 2, True), ("None", "None", 1, True), ("6", "6", 1, True), ("7", "7", 1, True)]
    )
    sha = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(df).collect()}
    assert sha[7] == hashlib.sha256("é".encode()).hexdigest()
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(df, stays="any")


def test_texts_with_one_hash_stay_apart(spark):
    assert hashlib.md5(A).digest() == hashlib.md5(B).digest() and A != B
    df = spark.createDataFrame([(1, bytearray(A)), (2, bytearray(B)), (3, bytearray(A))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    groups = exact_dedup.exact_groups(df).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(tuple(r) for r in groups) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_deduplicated_keeps_one_whole_row(spark):
    df = frame(spark, [(3, "a"), (1, "a"), (1, "a"), (2, None), (4, ""), (None, "a")])
    assert sorted((r.doc_id, r.text, r.sha) for r in exact_dedup.deduplicated(df).collect()) == [(1, "a", "s"), (2, None, "s")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicated(df, stays="largest").collect()) == [(3, "a"), (4, "")]
    assert exact_dedup.deduplicated(df).columns == df.columns


def test_empty_table(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0 == exact_dedup.deduplicated(frame(spark, [])).count()
