from pyspark.sql import functions as F

from rosterlight.llm import language_id
from rosterlight.llm.common import id_fold

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) >= 40")
    got = language_id.identified(docs, id_fold(docs["doc_id"], 3) != 1).where(id_fold(F.col("doc_id"), 3) == 1)
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg(F.col("rejected").cast("int")).alias("gone"), F.max("score").alias("top")).first()
    assert r.right > 0.97 and r.gone < 0.01 and r.top <= 1


def test_nulls_no_letters_and_clashing_columns(spark):
    rows = [(1, "the cat and the dog went home", "en"), (2, "der Hund und die Katze gehen heim", "de"), (3, None, "en"), (4, "", None), (5, "1234 !!", "en"), (6, "日本", "en"), (7, "the dog", None), (7, "the dog", None), (None, "und die Katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("v", F.lit(1)).withColumn("k", F.lit(2))
    got = language_id.identified(df, F.lit(True)).collect()
    pred = {r.doc_id: (r.lang_pred, r.rejected) for r in got}
    assert len(got) == len(rows)
    assert pred[1][0] == pred[7][0] == "en" and pred[2][0] == pred[None][0] == "de"
    assert pred[3] == pred[4] == pred[5] == ("und", True)
    assert pred[6][0] in ("de", "en")
    nothing = language_id.identified(df, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    assert language_id.identified(df.limit(0), F.lit(True)).count() == 0


def test_far_texts_are_rejected(spark):
    rows = [(i, f"the cat and the dog number {i} went home in the rain and then the sun", "en") for i in range(40)]
    df = spark.createDataFrame([*rows, (99, "zqxj wvkq xxqz jjkw qqvx zzkx wqjx", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in language_id.identified(df, F.col("doc_id") < 90).collect()}
    assert got[99] and not any(got[i] for i in range(40))


def test_letterless_rows_do_not_cost_clusters_or_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IS NOT NULL").select("doc_id", "text", "lang")
    bad = spark.createDataFrame([(-k - 1, t, x) for x in ("de", "en", "es", "fr") for k, t in enumerate(["", "123 456", "!!! ??"])], "doc_id long, text string, lang string")
    learned = language_id.fit(docs.where("doc_id % 3 <> 0").union(bad).withColumnRenamed("doc_id", "id"))
    assert min(list(learned.owner).count(k) for k in range(len(learned.languages))) > 1
    assert (learned.least[:, 6:] > 0).all()
    letters = "qxzjkwvp"
    noise = [(k, " ".join("".join(letters[(k * 7 + i * i + j * (i + 3)) % 8] for j in range(5 + i % 3)) for i in range(20 + k % 60)), "no") for k in range(60)]
    got = language_id.predicted(spark.createDataFrame(noise, "doc_id long, text string, lang string"), learned)
    assert got.where("rejected").count() >= 58
    own = language_id.predicted(docs.where("doc_id % 3 = 0 AND length(text) >= 40"), learned)
    assert own.where("rejected").count() <= 0.01 * own.count()


def test_a_language_left_out_is_rejected_more_than_learned_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IS NOT NULL AND length(text) >= 200").select("doc_id", "text", "lang")
    learned = language_id.fit(docs.where("doc_id % 3 <> 0 AND lang <> 'de'").withColumnRenamed("doc_id", "id"))
    r = {r.out: r.gone for r in language_id.predicted(docs.where("doc_id % 3 = 0"), learned).groupBy((F.col("lang") == "de").alias("out")).agg(F.avg(F.col("rejected").cast("int")).alias("gone")).collect()}
    assert r[False] < 0.01 and r[True] > 0.8, r


def test_predictions_match_brute_force(spark):
    """Vectors, cosines, nearest centroid and rejection, by a plain loop over each text's n-grams."""
    import math
    from collections import Counter

    import numpy as np

    from rosterlight.llm.kernels import mix

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    learned = language_id.fit(docs.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "id"))
    odd = spark.createDataFrame([(-1, "the " * 40_000, None), (-2, "É", None), (-3, "a", None), (-4, "12 ab 34", None)], "doc_id long, text string, lang string")
    rows = docs.where("doc_id % 3 = 0").limit(150).union(odd).collect()
    got = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame(rows, docs.schema), learned).collect()}
    for r in rows:
        raw = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in (r.text or "").encode())
        code = b" " + raw + b" "
        while b"  " in code:
            code = code.replace(b"  ", b" ")
        grams = Counter(code[i : i + k] for k in language_id.ORDERS for i in range(len(code) - k + 1))
        slots = Counter()
        for g, n in grams.items():
            slots[int(mix(np.array([int.from_bytes(bytes([len(g)]) + g, "big")], np.uint64))[0]) >> 52] += n
        v = {s: math.log1p(n) * float(learned.idf[s]) for s, n in slots.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cosines = [sum(x / length * float(c[s]) for s, x in v.items()) for c in learned.centroids]
        best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
        if not any(map(str.isalpha, r.text or "")):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].rejected) == ("und", True)
            continue
        assert got[r.doc_id].lang_pred == learned.languages[learned.owner[best]]
        assert abs(got[r.doc_id].score - min(1, max(0, cosines[best]))) < 1e-4
        band = min(int(math.log2(max(1, sum(slots.values())))), language_id.BANDS - 1)
        limit = float(learned.least[best, band])
        assert abs(cosines[best] - limit) < 1e-4 or got[r.doc_id].rejected == (cosines[best] < limit)


def test_a_language_of_copies_keeps_its_centroid_and_many_labels_are_learned(spark):
    en = spark.range(600).select("id", F.concat(F.lit("the cat and the dog number "), F.col("id"), F.lit(" went home")).alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(5000).select(F.lit(7).cast("long").alias("id"), F.lit("und die Katze geht heim").alias("text"), F.lit("xx").alias("lang"))
    learned = language_id.fit(en.union(copies))
    assert {learned.languages[k] for k in learned.owner} == {"en", "xx"}
    many = spark.range(1400).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), F.concat(F.lit("l"), F.col("id") % 700).alias("lang"))
    learned = language_id.fit(many)
    assert len(set(learned.owner)) == 700 and len(learned.owner) <= language_id.MOST_CENTROIDS


def test_ties_go_to_the_first_language_and_own_columns_keep_their_values(spark):
    df = spark.createDataFrame([(i, "same words in both tongues here", x, 5.0) for i, x in enumerate(["zz", "aa"] * 5)], "doc_id long, text string, lang string, score double")
    got = language_id.identified(df, F.lit(True)).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(r["score_"] == 5.0 and r["score"] > 0.99 for r in got)
