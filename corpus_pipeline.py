"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns a DataFrame; ``run``
writes it in the shared folder and reads it again for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterlight.llm import exact_dedup, language_id, minhash, packing, quality
from rosterlight.llm.common import free_name, id_fold, stored, table
from rosterlight.llm.queries import WORD_BPE

WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and rejected documents go whole.  Null and very short texts are rejected."""
    return quality.cleaned(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language (no letter, or too far from every centroid) go; the rest keep their own lang.

    The model learns from two thirds of the rows with a lang; without any such row every document would be unknown, so
    all stay.
    """
    learn = id_fold(docs["doc_id"], 3) != 1
    model = language_id.fit(docs.where(learn).select(docs["doc_id"].alias("id"), "text", "lang"))
    if not model.languages:
        return docs
    lang, score, rejected = (free_name(docs, c) for c in ("pred__", "score__", "rejected__"))
    return language_id.predicted(docs, model, lang=lang, score=score, rejected=rejected).where(f"NOT `{rejected}`").select(*[f"`{c}`" for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return minhash.thinned(docs, words=WORDS, percent=PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in a sequence."""
    return packing.report(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality", quality_rules), ("language", language), ("exact", exact), ("near", near), ("pack", pack)]

#: No SQL expresses language, near-duplicate and packing stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
