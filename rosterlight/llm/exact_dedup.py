"""Exact dedup: rows are grouped by a 128-bit content hash, and inside a group by their bytes.

The grouping key is (md5, text): Spark's aggregate compares the bytes of rows whose hashes agree, so two texts
with one hash stay two groups.  Copies are merged before the shuffle, so a text that a third of all rows share
reaches a reducer once per map task.  Rows find their group by md5, length and sha-256 in a join without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name


def _hashes(text: Column) -> list[Column]:
    return [F.unhex(F.md5(text.cast("binary"))).alias("h"), F.length(text.cast("binary")).alias("bytes"), F.sha2(text, 256).alias("sha")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id (the smallest or largest id of the rows with this text), group_size, kept, text_sha256.

    A null text is an empty one.  A null id loses against any other; where all ids of a group are null, keep_id is
    null and all its rows are kept.  Rows with the same id and text cannot be told apart here, so they share their
    verdict (``deduplicated`` leaves one).  An empty table gives an empty result; other columns play no part.
    """
    if stays not in ("smallest", "largest"):
        raise ValueError("stays: smallest or largest")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    best = F.min("id") if stays == "smallest" else F.max("id")
    groups = (
        rows.groupBy(F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), "text")
        .agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(*_hashes(F.col("text")), "keep_id", "group_size")
    )
    named = docs.select(docs[id_col].alias("id"), *_hashes(F.coalesce(docs[text_col], F.lit(""))))
    return named.join(groups, ["h", "bytes", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: one row per distinct text, in one shuffle.

    The row with the smallest (or largest) id stays; of rows that repeat id and text one stays.  A null text equals
    an empty one; the null or empty spelling of the row that stays is kept.  A null id loses against any other.
    """
    if stays not in ("smallest", "largest"):
        raise ValueError("stays: smallest or largest")
    h, text, rest = free_name(docs, "h_"), free_name(docs, "t_"), free_name(docs, "rest_")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] + [docs[text_col].isNull().alias(free_name(docs, "was_null_"))]
    order = F.struct(docs[id_col].isNotNull(), docs[id_col]) if stays == "largest" else F.struct(docs[id_col].isNull(), docs[id_col])
    pick = F.max_by if stays == "largest" else F.min_by
    filled = F.coalesce(docs[text_col], F.lit(""))
    one = docs.groupBy(F.unhex(F.md5(filled.cast("binary"))).alias(h), filled.alias(text)).agg(pick(F.struct(*others), order).alias(rest))
    null = F.col(f"{rest}.{free_name(docs, 'was_null_')}")
    return one.select(*[F.when(~null, F.col(text)).alias(c) if c == text_col else F.col(f"{rest}.`{c}`").alias(c) for c in docs.columns])
