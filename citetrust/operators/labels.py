"""Splits, label projection and label masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How labels are stored, and from which stored number on a label counts as set.
LABEL_SET, LABEL_UNSET = "1.0", "0.0"
LABEL_THRESHOLD = 0.9999

Split = int | Column | None


def encode_label(flag: Column) -> Column:
    return F.when(flag, LABEL_SET).otherwise(LABEL_UNSET)


def decode_label(stored: Column) -> Column:
    return stored.cast("float") >= F.lit(LABEL_THRESHOLD).cast("float")


def before_split(df: DataFrame, split: Split = None, key: str = "rev_id_ta") -> DataFrame:
    """Rows before the split; everything without one."""
    return df if split is None else df.where(F.col(key) < split)


def from_split(df: DataFrame, split: Split = None, key: str = "rev_id_ta") -> DataFrame:
    """Rows from the split on; everything without one."""
    return df if split is None else df.where(F.col(key) >= split)


def labels(revisions: DataFrame) -> DataFrame:
    """Ground-truth labels of labelled revisions in their stored form."""
    return revisions.select(
        "revision_id",
        "pair_id",
        encode_label(F.col("ta_gt")).alias("templateAdded"),
        encode_label(F.col("tr_gt")).alias("templateRemoved"),
    )


def mask_labels(revisions: DataFrame, split: Split) -> DataFrame:
    """Clear the working labels from the split on; ground truth keeps the labels as they were."""
    known = F.col("revision_id") < split
    return revisions.withColumns(
        {
            "ta_gt": F.col("ta"),
            "tr_gt": F.col("tr"),
            "ta": F.col("ta") & known,
            "tr": F.col("tr") & known,
        }
    )
