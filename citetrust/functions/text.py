"""Wikitext -> cited sources, built from Spark's own string and array functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citetrust.functions.domains import hosts_domains, url_domains, url_host

# The patterns that decide what counts as a citation.
REF = r"(?i)(?:<ref[^>]*>(.*?)</ref>|&lt;ref[^&]*&gt;(.*?)&lt;/ref&gt;)"
CITE = r"\{\{(?i)(cite|citation|vcite2|vcite|vancite|wikicite|wayback)[^}]*\}\}"
URL_FIELD = r"(?i)url\s*=\s*([^|\}]+)"
ISBN_FIELD = r"(?i)isbn\s*=\s*([^|\}]+)"
URL = r'https?://[^\s<>"]+'
NOT_ISBN = r"[^0-9X]"
BRACKETS = r"[\[\]{}()]"
ISBN_PREFIX = "ISBN:"


# Expressions inside lambdas are evaluated as often as they are written, so each step below names its
# input once and passes its result on through the array; "no match" is the empty string.


def _find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _cite_field(cite: Column, pattern: str) -> Column:
    return F.regexp_extract(cite, pattern, 1)


def _or_none(sources: Column) -> Column:
    return F.coalesce(sources, F.array().cast("array<string>"))


def template_present(text: Column, template: str) -> Column:
    """Whether ``{{template}}`` or ``{{template|`` stands in the text, in any case."""
    opening = "{{" + template.lower()
    low = F.lower(text)
    # The plain search rejects most texts before the ending is looked at.
    found = low.contains(opening) & low.rlike(rf"\Q{opening}\E(?:\}}\}}|\|)")
    return F.coalesce(found, F.lit(False))


def _ref_hosts(text: Column) -> Column:
    # No URL goes over a line end, so the refs of a text can be searched as the lines of one.
    refs = F.array_join(_find_all(text, REF, 1), "\n")
    return F.transform(_find_all(refs, URL), url_host)


def ref_urls(text: Column, suffixes: Iterable[str]) -> Column:
    """Domains of all URLs inside ``<ref>`` elements, in text order and with repeats."""
    return _or_none(hosts_domains(_ref_hosts(text), suffixes))


def _isbn(cite: Column) -> Column:
    digits = F.regexp_replace(_cite_field(cite, ISBN_FIELD), NOT_ISBN, "")
    return F.concat(F.lit(ISBN_PREFIX), digits)


def cite_urls(text: Column, suffixes: Iterable[str]) -> Column:
    """Domain of the first ``url=`` value of every cite template."""
    urls = F.transform(_find_all(text, CITE), lambda c: _cite_field(c, URL_FIELD))
    return _or_none(url_domains(urls, suffixes))


def isbns(text: Column) -> Column:
    """``ISBN:<digits>`` for the first ``isbn=`` value of every cite template."""
    found = F.transform(_find_all(text, CITE), _isbn)
    return _or_none(F.filter(found, lambda i: i != ISBN_PREFIX))


def extract_sources(text: Column, suffixes: Iterable[str]) -> Column:
    """All cited sources: ref URLs, then URL and ISBN of each cite template; first mention kept."""
    cited = F.flatten(
        F.transform(
            _find_all(text, CITE),
            lambda c: F.array(url_host(_cite_field(c, URL_FIELD)), _isbn(c)),
        )
    )
    # No host has a colon, so ISBNs can pass through the list of hosts.
    sources = hosts_domains(F.concat(_ref_hosts(text), cited), suffixes, other=ISBN_PREFIX)
    return _or_none(F.array_distinct(F.filter(sources, lambda s: s != ISBN_PREFIX)))


def inline_sources(
    text: Column, template: str, suffixes: Iterable[str]
) -> Column:
    """Domains of refs that are a bare URL and stand directly before ``{{template``."""
    flagged = REF + r"\s*?\{\{\Q" + template + r"\E"
    # Only one of the two forms of a ref matches; the other group is empty.
    urls = F.transform(_find_all(text, flagged), lambda m: F.regexp_replace(m, flagged, "$1$2"))
    return _or_none(F.array_distinct(url_domains(urls, suffixes)))


def cleanup_source(source: Column) -> Column:
    """Source name up to its first pipe, without brackets."""
    return F.regexp_replace(F.substring_index(source, "|", 1), BRACKETS, "")


def template_slug(template: str) -> str:
    """Template name as used in folder names."""
    return template.lower().replace(" ", "-")
