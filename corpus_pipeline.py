"""A training corpus from ``documents``: filtering, near-duplicate and repeat removal, packing.

Every stage works on all rows that the stage before kept, and all but the last return the columns of documents. No
stage leaves a Python worker to its caller, whose batches may be of any size: what workers find is stored (see
``stored``). Stages that choose documents store the keys of their choice alone, so that texts are on disk once, in what
the caller writes; tables that a stage needs on its way are removed before it returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrust.llm import language, mil, ngram_join, packing, repeats
from citetrust.llm.work import removed, stored, stored_alone, table
from citetrust.session import remove

ID, HASH = "_chosen_id", "_chosen_hash"  # names that no column of documents has


def chosen(docs: DataFrame, choice: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``choice()``, with all their columns, as often as they come.

    Stored are ids and 64-bit hashes of texts; the rows are a semi-join with these.
    """

    def keys() -> DataFrame:
        return choice().select(F.col("doc_id").alias(ID), F.xxhash64("text").alias(HASH))

    kept = stored_alone(docs.sparkSession, keys, name)
    same = docs["doc_id"].eqNullSafe(kept[ID]) & (F.xxhash64(docs["text"]) == kept[HASH])
    return docs.join(kept, same, "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance classifier, learned from ``labels``, accepts."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return chosen(docs, lambda: mil.accepted(docs.select("doc_id", "text"), labels), "quality-classifier")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return chosen(docs, lambda: language.understood(docs.select("doc_id", "text", "lang")), "language-id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a Jaccard index of 0.8 or more."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what an earlier one holds in 50 bytes or more; ``n_chars`` follows the text."""
    return stored_alone(spark, lambda: repeats.without_repeats(docs), "suffix-dedup")


def best_two_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences, see ``packing.pack_documents``."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_two_fit),
]
CHOICES = (quality_classifier, language_id, near_duplicates)  # their results are joins, not stored yet
ORACLE_SQL = None  # no stage can be said in SQL; tests hold each against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each one's result written as Parquet and read again.

    A result goes when the next one is written, so texts are stored twice at most; the last stage stores no texts.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with removed(spark) as folders:
            docs = stage(spark, docs, sf_dir)
            if stage in CHOICES:
                docs = stored(docs, name.replace(" ", "-"))
            last = folders.pop()
        if before:
            remove(spark, before)
        before = last
    packed = best_two_fit(spark, docs, sf_dir)
    remove(spark, before)
    return packed
