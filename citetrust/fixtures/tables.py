"""Revision histories derived from the given tables ``events`` and ``pages``.

The given tables hold no wikitext. A user's events become a page's revisions (in order of event id), and
each revision cites URLs: one from ``pages``, others that its page keeps over time. Texts contain block and
inline templates, bare and wrapped refs, cite templates with URL and ISBN, and sources that come and go.
The statement runs unchanged in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citetrust.fixtures.suffixes import SHORT_SUFFIXES

BLOCK_TEMPLATE = "Disputed"
INLINE_TEMPLATE = "Disputed inline"
# Hosts of ``pages`` end in these; as suffixes they leave one more label to tell sources apart.
SUFFIXES = (*SHORT_SUFFIXES, "example.com", "example.net", "example.org")

# The page of an event, and pages of at most 40 revisions for dumps, where a page is one stretch of text.
PAGE_OF_USER = "user_id"
PAGE_OF_RUN = "cast(floor(event_id / 40) as bigint)"


def revisions_sql(page: str = PAGE_OF_USER) -> str:
    return f"""
select page_id, rev_id, rev_id as pos, concat(
    case when event_type in ('error', 'click') then '{{{{Disputed|date=May}}}} '
         when rev_id % 17 = 0 then '{{{{disputed}}}} ' else 'Text. ' end,
    case when rev_id % 11 = 0 then '' else concat(
        case when rev_id % 5 = 0 then '' else concat('<ref>see ', kept_url, ' ok</ref>', chr(10)) end,
        '<ref name=b>', case when rev_id % 3 = 0 then cited_url else kept_url_2 end, '</ref>',
        case when event_type in ('view', 'error') then '{{{{Disputed inline}}}}' else '' end,
        ' and <ref>', cited_url, '</ref>', chr(10),
        case when page_id % 4 = 0 then '' else concat(
            '{{{{cite web|url=', kept_url_3, '|isbn=978-0-',
            case when rev_id % 13 = 0 then 1000 + rev_id else rev_id % 50 end, '-X}}}}') end,
        case when page_id % 9 = 0 then ' <ref>(http://www.s7.org)</ref>' else '' end,
        case when page_id % 10 = 0
             then ' <ref>{{{{Cite news|url=http://n1.com|title=x}}}}</ref>' else '' end) end) as text
from (
    select {page} as page_id, event_id as rev_id, event_type, u.url as cited_url,
        concat('https://www.s', {page} % 23, '.co.uk/a') as kept_url,
        concat('http://lib.u', {page} % 7, '.ac.at/b?c=1') as kept_url_2,
        concat('http://m.t', {page} % 5, '.x.ck:80/d#e') as kept_url_3
    from (select *, event_id % (select count(*) from pages) as cited from events) e
    left join pages u on u.page_id = e.cited) r
"""


# The columns that are used, so that reading needs no look at the files first.
SCHEMAS = {
    "events": "event_id bigint, user_id bigint, event_type string",
    "pages": "page_id bigint, url string",
}


def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """The given tables as views."""
    for name in SCHEMAS:
        given_table(spark, sf_dir, name).createOrReplaceTempView(name)


def revisions(spark: SparkSession, sf_dir: str, page: str = PAGE_OF_USER) -> DataFrame:
    register_tables(spark, sf_dir)
    return spark.sql(revisions_sql(page))
