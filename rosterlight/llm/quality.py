"""Quality rules, line first: each line is judged alone, failing lines go, and a document that loses too much text goes whole.

Built-in functions only; nothing is shuffled, so a document costs what its own length costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, making_room

# The characters that separate words, and those counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Phrases of web boilerplate, looked for in short lines.
BOILERPLATE = (
    "cookie policy",
    "accept cookies",
    "accept all cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "click here",
    "skip to content",
    "share on facebook",
    "back to top",
)
WINDOW = 5


def _without(text: Column, letters: str) -> Column:
    """``text`` less some characters: a chain of byte searches, each of which costs little where its character is rare."""
    for x in letters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def _measured(lines: Column) -> Column:
    """Of each line: its text x and its bare text, blanks removed."""
    return F.transform(lines, lambda x: F.struct(x.alias("x"), _without(x, BLANKS).alias("bare")))


def _counted(lines: Column) -> Column:
    """Of each measured line also: letters (non-blank characters), gaps (blanks), noise, bangs and bars."""
    n = lambda s, letters: (F.length(s["bare"]) - F.length(_without(s["bare"], letters)))
    return F.transform(
        lines,
        lambda s: F.struct(
            s["x"].alias("x"),
            s["bare"].alias("bare"),
            F.length(s["bare"]).alias("letters"),
            (F.length(s["x"]) - F.length(s["bare"])).alias("gaps"),
            n(s, "#*$%&<>").alias("noise"),
            n(s, "!").alias("bangs"),
            n(s, "|").alias("bars"),
        ),
    )


def line_fails(s: Column, boilerplate_words: int = 20, fragment_words: int = 3) -> Column:
    """Whether a counted line is symbol noise, shouting, navigation, boilerplate or an unfinished fragment.

    A line without a word fails nothing: it carries no text.
    """
    noisy = s["noise"] * 10 > s["letters"]
    shouting = s["bangs"] * 10 > s["letters"]
    navigation = (s["bars"] >= 3) & (s["bars"] * 4 >= s["gaps"])
    boilerplate = (s["gaps"] < boilerplate_words) & F.lower(s["x"]).rlike("|".join(BOILERPLATE))
    fragment = (s["gaps"] < fragment_words - 1) & ~s["bare"].rlike(r"[.!?:;,\"'”»)\]]$")
    return (s["letters"] > 0) & (noisy | shouting | navigation | boilerplate | fragment)


def judged(docs: DataFrame, text_col: str = "text", most_lost: float = 0.5, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """``docs`` with a struct column ``quality``: the counts, base_failed, kept and the cleaned text.

    Null text is an empty one: no words, base_failed.  kept is false for base_failed documents and for those whose
    failing lines hold more than ``most_lost`` of their non-blank characters.  Repeated rows get equal verdicts, an
    empty table gives an empty one, and an own column of ``docs`` named quality comes out as quality_.
    """
    docs = making_room(docs, "quality") if text_col.lower() != "quality" else docs
    t, words, lines, good, win, order, at = (free_name(docs, x) for x in ("t_", "words_", "lines_", "good_", "win_", "order_", "at_"))
    c = F.col
    step = docs.withColumn(t, F.coalesce(docs[text_col], F.lit("")))
    step = step.withColumn(words, _words(c(t))).withColumn(lines, _measured(F.split(c(t), "\n", -1)))
    step = step.withColumn(
        win,
        F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(c(words), i + k) for k in range(WINDOW)]))
        ),
    ).withColumn(lines, _counted(c(lines)))
    step = step.withColumn(good, F.transform(F.filter(c(lines), lambda x: ~line_fails(x)), lambda x: F.struct(x["x"].alias("x"), x["letters"].alias("letters"))))
    step = step.withColumn(order, F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn(
        at,
        F.when(
            c(order).isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(c(order), lambda x, k: (F.get(c(order), k - 1)["h"] == x["h"]) | (F.get(c(order), k + 1)["h"] == x["h"])),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform(c(at), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c(at), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    worded = F.transform(F.filter(c(lines), lambda x: x["letters"] > 0), lambda x: x["x"])
    chars = F.aggregate(c(lines), F.lit(0), lambda a, x: a + x["letters"])
    left = F.aggregate(c(good), F.lit(0), lambda a, x: a + x["letters"])
    n_words, n_repeat = F.size(words).cast("long"), F.coalesce(covered, F.lit(0)).cast("long")
    clean = F.array_join(F.transform(good, lambda x: x["x"]), "\n")
    failed = (n_words < min_words) | (n_repeat * 100 > n_words * most_repeated)
    lost = left < chars * (1 - most_lost)
    return step.select(
        *[docs[x] for x in docs.columns],
        F.struct(
            n_words.alias("n_words"),
            chars.cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(c(t), SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
            n_repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
            clean.alias("text"),
        ).alias("quality"),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed and kept of every document."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    q = judged(own).select("id", "quality.*")
    return q.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, same columns, their failing lines removed."""
    name = free_name(docs, "quality_")
    own = docs.withColumnRenamed("quality", name) if "quality" in docs.columns else docs
    # a filter right above would be pushed below all the steps, which then stand in it many times over; a generator stops it
    rest = [F.col(f"`{c}`") for c in own.columns]
    kept = judged(own, text_col).select(*rest, F.explode_outer(F.array("quality")).alias("quality")).where("quality.kept")
    return kept.select(*[(F.col("quality.text") if c == text_col else F.col(f"`{name if c == 'quality' else c}`")).alias(c) for c in docs.columns])
