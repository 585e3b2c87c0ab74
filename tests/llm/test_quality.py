import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rosterlight.llm import quality


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), len(words) < 10 or 100 * len(at) > 20 * len(words)


def test_counts_match_brute_force(spark):
    rnd = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n\x0b\x0c\r\t"), (4, "a " * 5000), (5, "é\xa0ü \U0001f642 x\n\nx\nx "), (5, "one\ntwo"), (None, "a b c d e f g a b c d e f"), (6, "\n".join(["same line here."] * 4))]
    rows += [(10 + i, "".join(rnd.choice(["a", "b", "c", "#", "|", "é"]) + rnd.choice([" ", " ", "\n", "\t"]) for _ in range(rnd.randrange(120)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(1)).withColumn("words_", F.lit(2))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.report(df).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in rows)


def test_clean_texts_stay_and_junk_goes(spark):
    clean = "It was a long day in the field, and nobody came back before the rain.\nThe others had gone home, as they said they would.\nReleased under the MIT License."
    rows = [
        (1, clean),
        (2, "\n".join("Was*** in### the&&& field%%% and### nobody*** came&&& back$$$ before%%% rain" + "!" * i for i in range(3))),
        (3, "Home | about | news | shop | cart | help | login | join | more | terms\n" * 1 + "One | two | three | four | five | six | seven | eight | nine"),
        (4, "STOP!! LOOK!! HERE!! NOW!! BUY!! ALL!! OF!! THIS!! TODAY!! OR!! NEVER!! AGAIN!!"),
        (5, clean + "\nAccept all cookies\nHome | about | news | shop | help"),
        (6, "too short"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("own"))
    got = {r.doc_id: r for r in quality.cleaned(df).collect()}
    assert set(got) == {1, 5}
    assert got[1].text == got[5].text == clean and got[1].quality == "own"
    assert quality.cleaned(df.limit(0)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = quality.report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_judged_renames_a_column_of_its_own_name_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "some words", "own")], "doc_id long, text string, quality string")
    row = quality.judged(df).first()
    assert (row["quality_"], row["quality"]["n_words"]) == ("own", 2)
    assert quality.report(df.limit(0)).count() == quality.judged(df.limit(0)).count() == 0
