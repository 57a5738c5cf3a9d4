"""Score revisions from the estimates of the sources they cite.

Sources are looked up by a left join. No broadcast is forced: Spark broadcasts the estimates when their
measured size allows it, and otherwise sorts and merges, splitting the partitions of sources that very
many revisions cite (adaptive skew join). Equal revision rows are counted first and scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrust.functions.text import cleanup_source
from citetrust.functions.vectors import round_vector
from citetrust.operators.combine import COMBINERS, Combiner

# A revision row is known by its ids and its sources; ``copies`` counts equal rows.
REVISION = ["revision_id", "pair_id", "src"]
VOTES_KEY = ["revision_id", "pair_id", "list", "copies"]


def distinct_revisions(revisions: DataFrame) -> DataFrame:
    """Each revision row once, with the number of its ``copies``; the same revision may be in several pairs."""
    src = F.coalesce("src", F.array().cast("array<string>")).alias("src")
    return revisions.select("revision_id", "pair_id", src).groupBy(*REVISION).agg(F.count("*").alias("copies"))


def look_up_sources(distinct: DataFrame, estimates: DataFrame, clean: bool = False) -> DataFrame:
    """One row per distinct revision and source with that source's estimate, ``known`` or the neutral default.

    Names are looked up as cited. Estimates learned from changes carry cleaned names; ``clean`` cleans the cited ones
    as well. Revisions without sources have no rows here, so they don't meet in one task of the join.
    """
    names = F.transform("src", cleanup_source) if clean else F.col("src")
    # ``list`` tells lists of the same revision and pair apart.
    cited = distinct.select(
        "revision_id", "pair_id", F.xxhash64("src").alias("list"), "copies", F.explode(names).alias("src")
    )
    # Four decimals as doubles: means that fall on a rounding tie then do so in any order of summing.
    p_added = F.col("p_added").cast("double")
    known = estimates.select(
        "src",
        p_added.alias("p_added"),
        (1 - p_added).alias("p_removed"),
        "occurrences",
        F.lit(True).alias("known"),
    )
    return cited.join(known, "src", "left").select(
        *VOTES_KEY,
        "src",
        F.coalesce("p_added", F.lit(0.5)).alias("p_added"),
        F.coalesce("p_removed", F.lit(0.5)).alias("p_removed"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )


def without_sources(distinct: DataFrame) -> DataFrame:
    return distinct.where(F.size("src") == 0)


def score(
    revisions: DataFrame,
    estimates: DataFrame,
    combiner: str | Combiner = "weighted_sure",
    clean: bool = False,
) -> DataFrame:
    """Probability that the template was added / removed for every revision row.

    ``estimates`` are rounded source estimates (only ``src``, ``p_added`` and ``occurrences`` are used).
    Revisions without sources get (0.5, 0.5); the others what the combiner makes of their sources.
    """
    combine = COMBINERS[combiner] if isinstance(combiner, str) else combiner
    distinct = distinct_revisions(revisions)
    votes = look_up_sources(distinct, estimates, clean)
    combined = votes.groupBy(*VOTES_KEY).agg(combine().alias("vector"))
    neutral = F.struct(F.lit(0.5).alias("p_added"), F.lit(0.5).alias("p_removed"))
    columns = ["revision_id", "pair_id", "vector", "copies"]
    both = combined.select(*columns).unionByName(
        without_sources(distinct).withColumn("vector", neutral).select(*columns)
    )
    # As many output rows as there were revision rows.
    return both.select(
        "revision_id", "pair_id", "vector.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    ).drop("_copy")


def rounded_scores(scores: DataFrame) -> DataFrame:
    """Scores in their stored form: four decimals, null where a combiner gave NaN."""
    added, removed = round_vector(F.col("p_added"))
    return scores.withColumns({"p_added": added, "p_removed": removed})
