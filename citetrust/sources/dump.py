"""MediaWiki XML dumps with full page histories, read revision by revision.

A page's history can be larger than any row or task should be, so pages are not read as rows. The dump is
read as text records that end at ``</revision>``: bzip2 files split at their blocks, and one long page is
read by as many tasks as it has splits. A record names its page only if it is the page's first revision;
the other records get it from the closest header before them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citetrust.operators.pairing import block_sources, flags, inline_sources_of, pair_marked
from citetrust.session import scratch_folder

REVISION_SCHEMA = "id bigint, text struct<_VALUE:string>"

# What tells a revision of a dump apart: its file, the split it is read in, and its number there.
DUMP_PLACE = ["file", "block", "seq"]


def _header_value(header: Column, tag: str) -> Column:
    return F.regexp_extract(header, rf"<{tag}>\s*([^<]*?)\s*</{tag}>", 1)


def _fixed_splits(spark: SparkSession) -> SparkSession:
    """A session with the same settings in which every scan of the same files is cut in the same way.

    Spark cuts files by settings and, unless ``spark.sql.files.minPartitionNum`` is set, by the number of cores that
    are alive when a scan is planned. A scan keeps the session it was read with, so later changes don't reach it.
    """
    fixed = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if fixed.conf.isModifiable(key):
            fixed.conf.set(key, value)
    if fixed.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = fixed.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        fixed.conf.set("spark.sql.files.minPartitionNum", str(cores))
    return fixed


def read_dump(spark: SparkSession, folder: str, pattern: str = "*.bz2") -> DataFrame:
    """Revisions of all dump files in ``folder``, as they stand there.

    Columns: ``file``, ``block`` (start of the file split), ``seq`` (ascending inside a block), ``rev_id``,
    ``text``, and on the first revision of a page ``page`` (page_id, start: its ``seq``, main: whether the
    page is an article and not a redirect).
    A revision that is not well-formed XML fails the read. The places (``block`` and ``seq``) of the returned DataFrame
    are the same each time it is computed, whatever becomes of the cluster and the settings.
    """
    records = (
        _fixed_splits(spark).read.option("lineSep", "</revision>")
        .option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        )
        .where(F.col("value").contains("<revision>"))
    )
    revision = F.from_xml(
        F.concat(
            F.lit("<revision>"),
            F.substring_index("value", "<revision>", -1),
            F.lit("</revision>"),
        ),
        REVISION_SCHEMA,
        {"mode": "FAILFAST"},
    )
    # Markup only: inside texts the "<" is escaped. Pages without revisions may stand before the page.
    header = F.substring_index(F.substring_index("value", "<revision>", 1), "<page>", -1)
    page_id = F.coalesce(_header_value(header, "id").try_cast("bigint"), F.lit(-1))
    main = (_header_value(header, "ns") == "0") & ~header.contains("<redirect")
    page = F.struct(page_id.alias("page_id"), F.col("seq").alias("start"), main.alias("main"))
    starts_page = F.substring_index("value", "<revision>", 1).contains("<page>")
    return records.select(
        "file",
        "block",
        "seq",
        F.when(starts_page, page).alias("page"),
        revision.alias("revision"),
    ).select(
        "file",
        "block",
        "seq",
        "page",
        F.coalesce("revision.id", F.lit(-1)).alias("rev_id"),
        F.coalesce("revision.text._VALUE", F.lit("")).alias("text"),
    )


def with_pages(rows: DataFrame) -> DataFrame:
    """Give every dump row its ``page_id`` and ``start`` and keep articles only.

    Headers are carried forward inside each block; a block's first rows take the last header of the
    blocks before it, which is one row per block. ``rows`` is read twice and should be a stored table.
    """
    so_far = (Window.unboundedPreceding, Window.currentRow)
    in_block = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(*so_far)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    has_page = F.when(F.col("page").isNotNull(), F.col("seq"))
    entering = (
        rows.groupBy("file", "block")
        .agg(F.max_by("page", has_page).alias("page"))
        .select("file", "block", F.last("page", ignorenulls=True).over(earlier).alias("_entering"))
    )
    return (
        rows.withColumn("page", F.last("page", ignorenulls=True).over(in_block))
        .join(entering, ["file", "block"])
        .withColumn("page", F.coalesce("page", "_entering"))
        .where("page.main")
        .withColumns({"page_id": F.col("page.page_id"), "start": F.col("page.start")})
        .drop("page", "_entering")
    )


def _dump_pairs(spark: SparkSession, dump: DataFrame, template: str, scratch: str) -> DataFrame:
    """Pair flagged dump rows, which are stored first."""
    marked = flags(dump, template)
    marked.write.parquet(f"{scratch}/flags")
    rows = spark.read.schema(marked.schema).parquet(f"{scratch}/flags")
    return pair_marked(with_pages(rows), ["file", "start", "page_id"], "block", ["block", "seq"])


def dump_block_pairs(
    spark: SparkSession,
    folder: str,
    template: str,
    suffixes: Iterable[str],
    pattern: str = "*.bz2",
    scratch: str | None = None,
) -> DataFrame:
    """Pairs of a block template from a dump folder.

    ``scratch`` is the folder for the flags of all revisions (no texts); by default a new one below
    ``spark.checkpoint.dir``. The returned DataFrame reads it, and the texts at the ends of episodes from the dump.
    """
    dump = read_dump(spark, folder, pattern)
    scratch = scratch or scratch_folder(spark)
    found = _dump_pairs(spark, dump, template, scratch)
    return block_sources(found, dump, DUMP_PLACE, suffixes, scratch)


def dump_inline_pairs(
    spark: SparkSession,
    folder: str,
    template: str,
    suffixes: Iterable[str],
    pattern: str = "*.bz2",
    scratch: str | None = None,
) -> DataFrame:
    """Pairs of an inline template from a dump folder."""
    dump = read_dump(spark, folder, pattern)
    scratch = scratch or scratch_folder(spark)
    found = _dump_pairs(spark, dump, template, scratch)
    return inline_sources_of(found, dump, DUMP_PLACE, template, suffixes, scratch)
