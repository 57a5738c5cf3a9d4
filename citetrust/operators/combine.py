"""Combine the vectors of a revision's sources into one, as aggregates over (revision, source) rows.

A combiner returns one aggregate Column, a struct (p_added, p_removed). Inputs are the columns ``p_added``,
``p_removed``, ``occurrences`` of one revision's sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citetrust.functions.vectors import occurrence_weight

# Certainty, smallest usable totals, fewest votes, and the vector that marks a result
# as not usable.
CERTAIN = 0.999999
MIN_TOTAL = 1e-5
MIN_WEIGHT = 1e-3
MIN_VOTES = 3
UNSURE = (-0.5, 1.5)

Combiner = Callable[[], Column]

P_ADDED, P_REMOVED = "p_added", "p_removed"


def _vector(added: Column | float, removed: Column | float) -> Column:
    def number(p: Column | float) -> Column:
        return F.coalesce(p, F.lit(float("nan"))) if isinstance(p, Column) else F.lit(p)

    return F.struct(number(added).alias("p_added"), number(removed).alias("p_removed"))


def _shares(added: Column, removed: Column) -> Column:
    total = added + removed
    return _vector(F.try_divide(added, total), F.try_divide(removed, total))


def _all_certain(p: str) -> Column:
    return F.every(F.col(p) >= CERTAIN)


def _not_empty() -> Column:
    """First branch of a when chain: without any source there is nothing to combine."""
    return F.when(F.count("*") == 0, F.raise_error("no sources to combine"))


def _checked(chain: Column) -> Column:
    """Next branches of a when chain: invalid input is an error."""
    added, removed = F.col(P_ADDED), F.col(P_REMOVED)
    bad_p = F.some((added < 0) | F.isnan(added) | (removed < 0) | F.isnan(removed))
    bad_weight = F.some(F.col("occurrences") < 0)
    return chain.when(bad_p, F.raise_error("probabilities are negative or NaN")).when(
        bad_weight, F.raise_error("weights are negative")
    )


def _weighted_mean(p: str) -> Column:
    weight = occurrence_weight(F.col("occurrences"))
    return F.try_divide(F.sum(F.col(p) * weight), F.sum(weight))


def multiplicative() -> Column:
    """Normalised products. Certain sources that contradict each other give NaN.

    Products are kept in 32 bits, so NaN is also what very many sources give on both sides.
    """

    def product(p: str) -> Column:
        return F.coalesce(F.product(p), F.lit(1.0)).cast("float").cast("double")

    return _shares(product(P_ADDED), product(P_REMOVED))


def logarithmic() -> Column:
    """Normalised sums, except where all sources are certain or one side has no mass at all."""
    added, removed = F.sum(P_ADDED), F.sum(P_REMOVED)
    return (
        _not_empty()
        .when(_all_certain(P_ADDED), _vector(1.0, 0.0))
        .when(_all_certain(P_REMOVED), _vector(0.0, 1.0))
        .when((added == 0) | (removed == 0), _vector(float("nan"), float("nan")))
        .when(added + removed <= MIN_TOTAL, _vector(0.5, 0.5))
        .otherwise(_shares(added, removed))
    )


def weighted() -> Column:
    """Mean weighted by how many votes each source has."""
    total = F.sum(occurrence_weight(F.col("occurrences")))
    return (
        _checked(_not_empty())
        .when(_all_certain(P_ADDED), _vector(1.0, 0.0))
        .when(_all_certain(P_REMOVED), _vector(0.0, 1.0))
        .when(total < MIN_WEIGHT, _vector(0.5, 0.5))
        .otherwise(_vector(_weighted_mean(P_ADDED), _weighted_mean(P_REMOVED)))
    )


def weighted_sure() -> Column:
    """Weighted mean, or the unsure vector if a source has no votes or there are too few sources."""
    votes = F.count("*")
    total = F.sum(occurrence_weight(F.col("occurrences")))
    unsure = (F.min("occurrences") < 1) | (votes < MIN_VOTES)
    mean = _weighted_mean(P_ADDED)
    return (
        _checked(_not_empty().when(unsure, _vector(*UNSURE)))
        .when(_all_certain(P_ADDED), _vector(1.0, 0.0))
        .when(_all_certain(P_REMOVED), _vector(0.0, 1.0))
        .when(total < MIN_WEIGHT, _vector(*UNSURE))
        .otherwise(_vector(mean, 1 - mean))
    )


COMBINERS: dict[str, Combiner] = {
    "multiplicative": multiplicative,
    "logarithmic": logarithmic,
    "weighted": weighted,
    "weighted_sure": weighted_sure,
}
