"""Episodes of a warning template: from the revision that adds it to the first one without it.

Pairs are found from flags: of every revision only its place and whether it has the template are stored, and only
these few bytes are shuffled. They are cut into ranges of places with about as many revisions each, whatever the
places are, ranges are paired in parallel, and only what is left open at their ends (at most two rows per range and
page) is followed across a page. A page with a third of all revisions is thereby spread over many tasks. Texts are
then read a second time, and sources are worked out for the revisions at both ends of an episode alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citetrust.functions.text import extract_sources, inline_sources, template_present
from citetrust.session import scratch_folder

# What a place in a revision table is made of.
TABLE_PLACE = ["page_id", "pos"]


def flags(revisions: DataFrame, template: str) -> DataFrame:
    """Replace ``text`` by ``has``: whether the revision has the template."""
    kept = [c for c in revisions.columns if c != "text"]
    return revisions.select(*kept, template_present(F.col("text"), template).alias("has"))


def _pair_in_chunks(marked: DataFrame, scope: Sequence[str], chunk: str, order: Sequence[str]) -> DataFrame:
    """Openings and closings of each chunk, paired where both lie in it.

    Returns rows (scope, chunk, order, has, opened, closed, edge). ``edge`` marks what earlier or later chunks may
    still change: the first closing of a chunk and an opening that its chunk never closes.
    """
    keys = [*scope, chunk] if chunk not in order else list(scope)
    in_chunk = Window.partitionBy(*scope, chunk).orderBy(*order)
    before = F.lag("has").over(in_chunk)
    turns = marked.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("has"))
    )
    revision = F.struct(*[c for c in marked.columns if c not in (*scope, chunk, "has") or c in order])
    turns = turns.select(*keys, *order, "has", revision.alias("revision"))
    # Turns alternate between with and without template, so a closing follows its opening.
    turns = turns.select(
        *keys,
        *order,
        "has",
        "revision",
        F.lag("revision").over(in_chunk).alias("_opened"),
        F.row_number().over(in_chunk).alias("_turn"),
        F.lead("has").over(in_chunk).isNull().alias("_last"),
    )
    return turns.where(~F.col("has") | F.col("_last")).select(
        *keys,
        *order,
        "has",
        F.when(F.col("has"), F.col("revision")).otherwise(F.col("_opened")).alias("opened"),
        F.when(~F.col("has"), F.col("revision")).alias("closed"),
        (F.col("has") | (F.col("_turn") <= 2)).alias("edge"),
    )


def pair_marked(marked: DataFrame, scope: Sequence[str], chunk: str, order: Sequence[str]) -> DataFrame:
    """Pair flagged revisions inside each ``scope`` along ``order``.

    ``chunk`` names a column that cuts a scope into consecutive pieces. Returns scope columns, ``opened`` and
    ``closed``: structs of all columns of ``marked`` but scope, chunk and ``has``.
    """
    found = _pair_in_chunks(marked, scope, chunk, order)
    # Edges of a scope meet in one group; finished pairs stay in a group of their own chunk.
    found = found.withColumn("_group", F.when(~F.col("edge"), F.col(chunk)))
    along = Window.partitionBy(*scope, "_group").orderBy(*order)
    # Of openings that follow each other the first counts; a closing then follows its opening, if it has one.
    first = found.withColumn("_before", F.lag("has").over(along)).where(
        ~F.col("has") | F.col("_before").isNull() | ~F.col("_before")
    )
    open_before = F.lag(F.when(F.col("has"), F.col("opened"))).over(along)
    return (
        first.withColumn("opened", F.coalesce(open_before, "opened"))
        .where(~F.col("has") & F.col("opened").isNotNull())
        .select(*scope, "opened", "closed")
    )


def _table_pairs(revisions: DataFrame, template: str, scratch: str) -> DataFrame:
    """Pair a revision table: flags are stored and dealt out in ranges of (page, position)."""
    narrow = revisions.select("page_id", "rev_id", "pos", "text")
    marked = _stored(flags(narrow, template), f"{scratch}/flags")
    dealt = marked.repartitionByRange(*TABLE_PLACE).withColumn("_range", F.spark_partition_id())
    return pair_marked(dealt, ["page_id"], "_range", ["pos"])


def with_closing_sources(pairs: DataFrame) -> DataFrame:
    """Drop pairs whose closing revision cites nothing: such a removal counts as vandalism."""
    return pairs.where(F.size("src_tr") > 0)


def pair_ends(found: DataFrame, place: Sequence[str]) -> DataFrame:
    """Both ends of each pair: (pair: place of its opening, ta, place..., rev_id)."""
    # A place lies in the scope (columns of ``found``) or in the revision structs.
    def at(side: str) -> list[Column]:
        return [(F.col(c) if c in found.columns else F.col(f"{side}.{c}")).alias(c) for c in place]

    def end(side: str, added: bool) -> Column:
        return F.struct(
            F.struct(*at("opened")).alias("pair"),
            F.lit(added).alias("ta"),
            *at(side),
            "page_id" if "page_id" not in place else F.lit(None).cast("bigint").alias("_none"),
            F.col(f"{side}.rev_id").alias("rev_id"),
        )

    both = F.array(end("opened", True), end("closed", False))
    return found.select(F.inline(both)).drop("_none")


def at_ends(ends: DataFrame, texts: DataFrame, place: Sequence[str]) -> DataFrame:
    """``ends`` that have a place, with their ``text``, found by place.

    An end without a row in ``texts`` is an error: these are not the texts that the pairs were found in. A runtime
    filter on the places of the stored ends drops most texts where they are read; Spark makes one only from a scan
    with a condition, hence the one on ``ta``.
    """
    known = F.forall(F.array(*[F.col(c).isNotNull() for c in place]), lambda c: c)
    wanted = ends.where(F.col("ta").isin(True, False) & known)
    read = wanted.join(texts.select(*place, F.struct("text").alias("_read")), list(place), "left")
    lost = F.raise_error(F.lit("no text at the end of an episode")).cast("string")
    text = F.when(F.col("_read").isNull(), lost).otherwise(F.col("_read.text"))
    return read.withColumn("text", text).drop("_read")


def paired(ends: DataFrame) -> DataFrame:
    """The two ends of each pair in one row again: (page_id, rev_id_ta, rev_id_tr, src_ta, src_tr)."""

    def one(added: bool, column: str) -> Column:
        return F.any_value(F.when(F.col("ta") == added, F.col(column)), True)

    return (
        ends.groupBy("pair")
        .agg(
            F.any_value("page_id").alias("page_id"),
            one(True, "rev_id").alias("rev_id_ta"),
            one(False, "rev_id").alias("rev_id_tr"),
            one(True, "src").alias("src_ta"),
            one(False, "src").alias("src_tr"),
        )
        .drop("pair")
    )


def block_sources(
    found: DataFrame, texts: DataFrame, place: Sequence[str], suffixes: Iterable[str], scratch: str
) -> DataFrame:
    """Pairs of a block template with all sources that their two revisions cite; the ends are stored in ``scratch``."""
    wanted = _stored(pair_ends(found, place), f"{scratch}/ends")
    ends = at_ends(wanted, texts, place)
    sourced = ends.withColumn("src", extract_sources(F.col("text"), suffixes)).drop("text")
    return with_closing_sources(paired(sourced))


def inline_sources_of(
    found: DataFrame, texts: DataFrame, place: Sequence[str], template: str, suffixes: Iterable[str], scratch: str
) -> DataFrame:
    """Pairs of an inline template: sources that it marks when it opens, and those of them still named at the end.

    The two texts of a pair meet once; no group is larger than that.
    """
    wanted = _stored(pair_ends(found, place), f"{scratch}/ends")
    ends = at_ends(wanted, texts, place)
    marked = F.when(F.col("ta"), inline_sources(F.col("text"), template, suffixes))
    sourced = ends.withColumn("src", F.struct(marked.alias("src"), F.when(~F.col("ta"), F.col("text")).alias("text")))
    pairs = paired(sourced)
    text = F.coalesce("src_tr.text", F.lit(""))
    still = F.filter("src_ta.src", lambda s: F.contains(text, s))
    kept = pairs.where(F.size("src_ta.src") > 0).select(
        "page_id", "rev_id_ta", "rev_id_tr", F.col("src_ta.src").alias("src_ta"), still.alias("src_tr")
    )
    return with_closing_sources(kept)


def block_pairs(
    revisions: DataFrame, template: str, suffixes: Iterable[str], scratch: str | None = None
) -> DataFrame:
    """Pairs of a block template from ``revisions(page_id, rev_id, pos, text)``.

    ``pos`` is the revision's place in its page's document order and unique there. ``revisions`` is read twice: for
    flags, which are stored below ``scratch`` (a new folder below ``spark.checkpoint.dir`` by default), and for the
    texts at the ends of episodes.
    """
    scratch = scratch or scratch_folder(revisions.sparkSession)
    found = _table_pairs(revisions, template, scratch)
    return block_sources(found, revisions, TABLE_PLACE, suffixes, scratch)


def inline_pairs(
    revisions: DataFrame, template: str, suffixes: Iterable[str], scratch: str | None = None
) -> DataFrame:
    """Pairs of an inline template. Sources of the opening revision are the refs the template marks."""
    scratch = scratch or scratch_folder(revisions.sparkSession)
    found = _table_pairs(revisions, template, scratch)
    return inline_sources_of(found, revisions, TABLE_PLACE, template, suffixes, scratch)


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written and read back: what follows does not compute it again."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pairs_to_revisions(pairs: DataFrame) -> DataFrame:
    """Each pair as its two revisions, labelled by what happened to the template."""

    def side(own: str, other: str, added: bool, src: str) -> Column:
        return F.struct(
            F.col(own).alias("revision_id"),
            F.col(other).alias("pair_id"),
            "page_id",
            F.lit(added).alias("ta"),
            F.lit(not added).alias("tr"),
            F.lit(added).alias("ta_gt"),
            F.lit(not added).alias("tr_gt"),
            F.col(src).alias("src"),
        )

    sides = F.array(
        side("rev_id_ta", "rev_id_tr", True, "src_ta"),
        side("rev_id_tr", "rev_id_ta", False, "src_tr"),
    )
    return pairs.select(F.inline(sides))
