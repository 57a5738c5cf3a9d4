"""Stored artifacts: pairs and revisions in Parquet, labels and probabilities in CSV.

A missing folder is Spark's own ``AnalysisException``. Many part files are written; ``single_file`` is
for small results only, since it writes with one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrust.operators.labels import decode_label, encode_label
from citetrust.schemas import STORED_PAIRS, STORED_REVISIONS

# CSV column names.
CSV_ADDED = "probabilityTemplateAdded"
CSV_REMOVED = "probabilityTemplateRemoved"
CSV_UNCHANGED = "probabilityTemplateUnchanged"
CSV_VOTES = "occurences"


def write_pairs(pairs: DataFrame, folder: str) -> None:
    stored = pairs.select(
        F.col("rev_id_ta").alias("revIdTA"),
        F.col("rev_id_tr").alias("revIdTR"),
        F.col("page_id").cast("int").alias("pageId"),
        F.col("src_ta").alias("srcTA"),
        F.col("src_tr").alias("srcTR"),
    )
    stored.write.mode("overwrite").option("compression", "snappy").parquet(folder)


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.schema(STORED_PAIRS)
        .parquet(folder)
        .select(
            F.col("pageId").cast("bigint").alias("page_id"),
            F.col("revIdTA").alias("rev_id_ta"),
            F.col("revIdTR").alias("rev_id_tr"),
            F.col("srcTA").alias("src_ta"),
            F.col("srcTR").alias("src_tr"),
        )
    )


def write_revisions(revisions: DataFrame, folder: str) -> None:
    stored = revisions.select(
        F.col("revision_id").alias("revId"),
        F.col("pair_id").alias("pairId"),
        F.col("page_id").cast("int").alias("pageId"),
        encode_label(F.col("ta")).alias("tA"),
        encode_label(F.col("tr")).alias("tR"),
        encode_label(F.col("ta_gt")).alias("tA_GT"),
        encode_label(F.col("tr_gt")).alias("tR_GT"),
        "src",
    )
    stored.write.mode("overwrite").option("compression", "snappy").parquet(folder)


def read_revisions(spark: SparkSession, folder: str, has_ground_truth: bool = True) -> DataFrame:
    """Without ground truth the stored copy is ignored and the working labels take its place."""
    truth = ("tA_GT", "tR_GT") if has_ground_truth else ("tA", "tR")
    return (
        spark.read.schema(STORED_REVISIONS)
        .parquet(folder)
        .select(
            F.col("revId").alias("revision_id"),
            F.col("pairId").alias("pair_id"),
            F.col("pageId").cast("bigint").alias("page_id"),
            decode_label(F.col("tA")).alias("ta"),
            decode_label(F.col("tR")).alias("tr"),
            decode_label(F.col(truth[0])).alias("ta_gt"),
            decode_label(F.col(truth[1])).alias("tr_gt"),
            "src",
        )
    )


def write_labels(labels: DataFrame, folder: str, single_file: bool = False) -> None:
    _write_csv(labels, folder, "overwrite", single_file)


def write_source_probs(estimates: DataFrame, folder: str, single_file: bool = False) -> None:
    """Rounded estimates, two-way or three-way; fails if the folder exists.

    Line breaks in names are escaped, so that the files can be split when they are read.
    """
    names = {
        "src": "src",
        "p_added": CSV_ADDED,
        "p_removed": CSV_REMOVED,
        "p_unchanged": CSV_UNCHANGED,
        "occurrences": CSV_VOTES,
    }
    stored = estimates.withColumn("src", _escaped(F.col("src"))).select(
        *[F.col(c).alias(name) for c, name in names.items() if c in estimates.columns]
    )
    _write_csv(stored, folder, "errorifexists", single_file)


def read_source_probs(spark: SparkSession, folder: str, line_breaks: bool = False) -> DataFrame:
    """Stored estimates; the removed side is what the added side leaves of 1, as in two-way files.

    Columns are found by their header, so three-way files can be read as well. Should a source occur twice, the line
    with more votes is kept, and of those the one with the larger share added. ``line_breaks`` is for files whose
    names are written as they are, over several lines if need be; each is then read by one task.
    """
    # Written names hold no line breaks (see write_source_probs), so files are split. Names may be empty.
    reader = spark.read.option("header", True).option("nullValue", "\0").option("multiLine", line_breaks)
    header = reader.csv(folder).columns  # the first line of one file
    lines = reader.option("enforceSchema", False).schema(", ".join(f"`{c}` string" for c in header)).csv(folder)
    p_added = F.col(CSV_ADDED).cast("double")
    votes = F.col(CSV_VOTES).cast("bigint")
    return (
        lines.select((F.col("src") if line_breaks else _unescaped(F.col("src"))).alias("src"), p_added.alias("p"), votes.alias("votes"))
        .groupBy("src")
        .agg(F.max(F.struct("votes", "p")).alias("best"))
        .select(
            "src",
            F.col("best.p").alias("p_added"),
            (1 - F.col("best.p")).alias("p_removed"),
            F.col("best.votes").alias("occurrences"),
        )
    )


def _escaped(name: Column) -> Column:
    """A source name in one line: a line break becomes a backslash and a letter, a backslash two."""
    for plain, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(plain), F.lit(escape))
    return name


def _unescaped(name: Column) -> Column:
    # Doubled backslashes wait under a character that no name holds.
    hidden = F.replace(name, F.lit("\\\\"), F.lit("\0"))
    for escape, plain in (("\\n", "\n"), ("\\r", "\r"), ("\0", "\\")):
        hidden = F.replace(hidden, F.lit(escape), F.lit(plain))
    return hidden


def write_revision_probs(scores: DataFrame, folder: str) -> None:
    """Rounded scores, overwriting; a vector that is not a number is stored as NaN."""

    def stored(p: str) -> Column:
        return F.coalesce(F.col(p).cast("string"), F.lit("NaN"))

    out = scores.select(
        "revision_id",
        stored("p_added").alias(CSV_ADDED),
        stored("p_removed").alias(CSV_REMOVED),
    )
    out.write.mode("overwrite").option("header", True).option("nullValue", "").csv(folder)


def _write_csv(df: DataFrame, folder: str, mode: str, single_file: bool) -> None:
    df = df.coalesce(1) if single_file else df
    writer = df.write.mode(mode).option("header", True)
    # Names are stored as they are, spaces at their ends included.
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(folder)
