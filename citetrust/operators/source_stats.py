"""Per-source estimates: how often a source goes with the template being added or removed.

Each is an explode followed by one two-phase aggregate. Counts are combined before the shuffle, so a
source cited by a third of all revisions sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrust.functions.text import cleanup_source
from citetrust.functions.vectors import ratio, round_three, round_vector


def _two_way(counted: DataFrame) -> DataFrame:
    """(src, added, removed) -> (src, p_added, p_removed, occurrences)."""
    total = F.col("added") + F.col("removed")
    return counted.select(
        "src",
        F.coalesce(ratio(F.col("added"), total), F.lit(0.5)).alias("p_added"),
        F.coalesce(ratio(F.col("removed"), total), F.lit(0.5)).alias("p_removed"),
        total.alias("occurrences"),
    )


def estimate_from_revisions(revisions: DataFrame) -> DataFrame:
    """Votes of labelled revisions: for "added" or, failing that, for "removed"."""
    votes = revisions.select(F.explode("src").alias("src"), "ta", "tr")
    counted = votes.groupBy("src").agg(
        F.count_if("ta").alias("added"),
        F.count_if(~F.col("ta") & F.col("tr")).alias("removed"),
    )
    return _two_way(counted)


def _sides(pairs: DataFrame, src_ta: Column, src_tr: Column) -> DataFrame:
    """One row per pair and source: on which sides the pair cites it.

    The two lists are compared by hashing before the explode, so a long list is not carried along and
    searched once per source.
    """

    def on(sources: Column, in_ta: bool, in_tr: bool) -> Column:
        sides = (F.lit(in_ta).alias("in_ta"), F.lit(in_tr).alias("in_tr"))
        return F.transform(sources, lambda s: F.struct(s.alias("src"), *sides))

    found = F.concat(
        on(F.array_except("src_ta", "src_tr"), True, False),
        on(F.array_except("src_tr", "src_ta"), False, True),
        on(F.array_intersect("src_ta", "src_tr"), True, True),
    )
    return pairs.select(src_ta.alias("src_ta"), src_tr.alias("src_tr")).select(F.inline(found))


def estimate_from_pairs(pairs: DataFrame) -> DataFrame:
    """Share of a source's pairs that cite it once the template is gone; the rest is "added"."""
    counted = (
        _sides(pairs, F.col("src_ta"), F.col("src_tr"))
        .groupBy("src")
        .agg(
            F.count_if(~F.col("in_tr")).alias("added"),
            F.count_if("in_tr").alias("removed"),
        )
    )
    return _two_way(counted)


def estimate_from_changes(pairs: DataFrame) -> DataFrame:
    """Only pairs in which the (cleaned) source came or went vote."""
    cleaned = [F.transform(c, cleanup_source) for c in ("src_ta", "src_tr")]
    counted = (
        _sides(pairs, *cleaned)
        .groupBy("src")
        .agg(
            F.count_if(F.col("in_ta") & ~F.col("in_tr")).alias("added"),
            F.count_if(~F.col("in_ta") & F.col("in_tr")).alias("removed"),
        )
    )
    return _two_way(counted)


def estimate_with_unchanged(pairs: DataFrame) -> DataFrame:
    """Three-way shares: source went, source came, source stayed."""
    counted = (
        _sides(pairs, F.col("src_ta"), F.col("src_tr"))
        .groupBy("src")
        .agg(
            F.count_if(F.col("in_ta") & ~F.col("in_tr")).alias("added"),
            F.count_if(~F.col("in_ta") & F.col("in_tr")).alias("removed"),
            F.count_if(F.col("in_ta") & F.col("in_tr")).alias("unchanged"),
        )
    )
    total = F.col("added") + F.col("removed") + F.col("unchanged")
    return counted.select(
        "src",
        ratio(F.col("added"), total).alias("p_added"),
        ratio(F.col("removed"), total).alias("p_removed"),
        ratio(F.col("unchanged"), total).alias("p_unchanged"),
        total.alias("occurrences"),
    )


def with_votes(estimates: DataFrame) -> DataFrame:
    """Drop sources nobody voted on."""
    return estimates.where(F.col("occurrences") > 0)


def rounded(estimates: DataFrame) -> DataFrame:
    """Estimates in their stored form, four decimals; this is what scoring starts from."""
    if "p_unchanged" in estimates.columns:
        added, removed, unchanged = round_three(F.col("p_added"), F.col("p_unchanged"))
        values = [added.alias("p_added"), removed.alias("p_removed"), unchanged.alias("p_unchanged")]
    else:
        added, removed = round_vector(F.col("p_added"))
        values = [added.alias("p_added"), removed.alias("p_removed")]
    return estimates.select("src", *values, "occurrences")
