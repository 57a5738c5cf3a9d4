"""An XML dump written by Spark from the derived revisions, one page after the other.

Pages are runs of at most 40 revisions here, so the sort that puts a page's revisions next to each other
never gathers a long history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def write_dump(revisions: DataFrame, folder: str) -> None:
    """``revisions(page_id, rev_id, pos, text)`` as ``*.bz2`` files with whole pages in each.

    Some pages are in another namespace (page_id % 7 = 3) or redirects (page_id % 7 = 5).
    """
    page = Window.partitionBy("page_id").orderBy("pos")
    first = F.lag("pos").over(page).isNull()
    last = F.lead("pos").over(page).isNull()
    kind = F.col("page_id") % 7
    redirect = F.when(kind == 5, '<redirect title="x" />').otherwise("")
    header = F.concat(
        F.lit("<page><title>t</title><ns>"),
        F.when(kind == 3, "1").otherwise("0"),
        F.lit("</ns><id>"),
        "page_id",
        F.lit("</id>"),
        redirect,
    )
    line = F.concat(
        F.when(F.col("_first"), header).otherwise(""),
        F.lit("<revision><id>"),
        "rev_id",
        F.lit("</id><contributor><id>1</id></contributor>"),
        F.lit('<text xml:space="preserve">'),
        _escaped(F.col("text")),
        F.lit("</text></revision>"),
        F.when(F.col("_last"), "</page>").otherwise(""),
    )
    marked = revisions.withColumns({"_first": first, "_last": last})
    ordered = marked.sortWithinPartitions("page_id", "pos")
    ordered.select(line.alias("value")).write.option("compression", "bzip2").text(folder)
