"""Numbers on probability vectors: ratios, weights and the 4-decimal output form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight curve over the number of votes, and the undecided tolerance.
WEIGHT_MAX = 100
WEIGHT_STEEPNESS = 0.05
UNDECIDED_TOLERANCE = 1e-4


def ratio(part: Column, total: Column) -> Column:
    """part / total with 32-bit precision, as a double; null where total is 0."""
    quotient = part.cast("float") / F.nullif(total, F.lit(0).cast("bigint")).cast("float")
    return quotient.cast("float").cast("double")


def occurrence_weight(occurrences: Column) -> Column:
    """Saturating weight of a source with that many votes: 0 for none, near 100 from 100 on."""
    n = F.least(occurrences, F.lit(WEIGHT_MAX))
    return WEIGHT_MAX - WEIGHT_MAX * F.exp(-WEIGHT_STEEPNESS * n)


def is_undecided(p_added: Column, p_removed: Column) -> Column:
    gap = p_added.cast("float") - p_removed.cast("float")
    return F.abs(gap) < F.lit(UNDECIDED_TOLERANCE).cast("float")


def round4(p: Column) -> Column:
    """Half-up to 4 decimals from the 32-bit value; NaN becomes null."""
    single = p.cast("float").cast("double")
    return F.when(~F.isnan(single), single).cast("decimal(10,4)")


def round_vector(p_added: Column) -> tuple[Column, Column]:
    """(added, removed) at 4 decimals; removed is what is left of 1."""
    added = round4(p_added)
    return added, (1 - added).cast("decimal(10,4)")


def round_three(p_added: Column, p_unchanged: Column) -> tuple[Column, Column, Column]:
    """(added, removed, unchanged) at 4 decimals; removed takes up the rounding error."""
    added, unchanged = round4(p_added), round4(p_unchanged)
    return added, (1 - added - unchanged).cast("decimal(10,4)"), unchanged
