"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Stages but the last take and return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitystore.llm import common
from entitystore.llm.cotraining import classify
from entitystore.llm.decontamination import excise
from entitystore.llm.line_dedup import line_dedup
from entitystore.llm.packing import VOCABULARY, pack
from entitystore.llm.simhash import one_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    A null text is scored as empty and stays null; null metadata is a value of its own.  Repeated rows fare
    alike.  Labels that do not hold both classes reject nothing.  Empty table: no rows.
    """
    return classify(docs, common.table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one with no word left goes, unless it had none before.

    A null text becomes an empty one.  Rows that repeat an id and a text are one text, and alike; a null id is
    one below all others.  n_chars of a text that lost lines is counted anew.  Empty table: no rows.
    """
    out = line_dedup(docs, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (id and text) of each group of near duplicates, the one of the least id; rows that repeat it are left out.

    Null and empty texts are one group.  Ids that repeat or are null join no groups.  Empty table: no rows.
    """
    return one_of_each(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold windows of two or more benchmark items; windows of one item are cut out.

    Null and empty texts have no windows and stay as they are.  Repeated rows fare alike.  Empty table: no rows.
    """
    return excise(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in packed sequences.

    A null or empty text is one piece of one token.  Repeated rows are packed each.  Empty table: no rows.
    """
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next, and its own intermediate tables go then."""
    scratch, docs, path = common.Scratch(spark), common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with common.temporary(spark):
            docs, new = scratch.save(stage(spark, docs, sf_dir))
        if path:
            scratch.drop(path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no co-training and no tokenizer; tests/llm holds line dedup, near duplicates, decontamination and packing against brute force, and what the classifier decides against held-out labels.
ORACLE_SQL = None
