"""How much sources change within pairs, and how many cited sources have no estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrust.operators.scoring import VOTES_KEY, distinct_revisions, look_up_sources


def count_source_changes(pairs: DataFrame) -> DataFrame:
    """One row: pairs whose sources changed, and pairs citing the same set in lists of equal length."""
    same = (
        (F.size("src_ta") == F.size("src_tr"))
        & (F.size(F.array_except("src_ta", "src_tr")) == 0)
        & (F.size(F.array_except("src_tr", "src_ta")) == 0)
    )
    return pairs.agg(F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"))


def count_unknown_sources(revisions: DataFrame, estimates: DataFrame) -> DataFrame:
    """One row: revisions, those with an unknown source, their percentage, their mean unknown share."""
    distinct = distinct_revisions(revisions)
    cited = look_up_sources(distinct, estimates)
    per_revision = (
        cited.groupBy(*VOTES_KEY)
        .agg(F.count_if(~F.col("known")).alias("n_unknown"), F.count("*").alias("n_cited"))
        .select("n_unknown", "n_cited", F.lit(0).cast("bigint").alias("revisions"), "copies")
    )
    # All revisions are counted apart, so that those without sources don't go through the look-up.
    counted = distinct.agg(F.sum("copies").alias("revisions"))
    none = F.lit(0).cast("bigint")
    per_revision = per_revision.unionByName(
        counted.select(none.alias("n_unknown"), none.alias("n_cited"), "revisions", none.alias("copies"))
    )
    share = F.try_divide("n_unknown", "n_cited")
    hit = F.col("n_unknown") > 0
    n, n_hit = F.sum("revisions"), F.sum(F.when(hit, F.col("copies")))
    total = F.coalesce(n, F.lit(0))
    with_unknown = F.coalesce(n_hit, F.lit(0))
    mean = F.try_divide(F.sum(F.when(hit, share * F.col("copies"))), with_unknown)
    return per_revision.agg(
        total.alias("revisions"),
        with_unknown.alias("with_unknown"),
        F.coalesce(F.try_divide(100 * with_unknown, total), F.lit(float("nan"))).alias("percentage"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_unknown_share"),
    )
