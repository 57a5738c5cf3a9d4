"""URL -> registrable domain as one row-local Column expression.

The suffix rules are a configuration list that the caller passes (domains are wrong under an incomplete one, so there
is no default). They travel inside the plan as hashed IN sets: no explode, no join and no shuffle, and the caller's
arrays stay whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The host is what stands between the scheme, optional user part and port, and the path;
# whitespace around the URL and one closing wiki bracket pair at its end are not part of it. Possessive
# repeats keep the match linear, and each URL is scanned once.
_END = r"[\x00-\x20]*(?:\}\}|\]\])?[\x00-\x20]*\z"
_HOST_CHARS = r"(?:[^/?#:@\]}\x00-\x20]++|(?!" + _END + r")(?:[\x00-\x20]++|[\]}]))*+"
_HOST = (
    r"^[\x00-\x20]*(?i:https?|ftp|file)://(?:[^/?#@]*@)?"
    "(" + _HOST_CHARS + r")(?::[0-9]*)?(?:[/?#]|" + _END + ")"
)


def url_host(url: Column) -> Column:
    """Lower-cased host of ``url``; empty or null if it is not a URL or has an open template in it."""
    return F.when(~url.contains("{{"), F.lower(F.regexp_extract(url, _HOST, 1)))


@lru_cache(maxsize=16)
def _domain_sql(suffixes: tuple[str, ...]) -> str:
    """SQL for the registrable domain of the lower-cased host ``h``.

    The longest matching suffix plus one label; null where the host is empty, is itself a suffix, or has
    an empty label. Written as text because the rules are many literals and Spark parses those faster than
    it takes them one by one; the optimizer turns the IN lists into hash sets.
    """
    if not suffixes:
        raise ValueError("no suffix rules: pass those of the public suffix list, see load_suffixes")
    exact, wildcard, excepted = defaultdict(set), defaultdict(set), defaultdict(set)
    for rule in suffixes:
        n = rule.count(".") + 1
        if rule.startswith("!"):  # the suffix is what follows the exception's first label
            excepted[n - 1].add(rule[1:])
        elif rule.startswith("*."):
            wildcard[n].add(rule[2:])
        else:
            exact[n].add(rule)

    def tail(n: int) -> str:
        return f"substring_index(h, '.', -{n})"

    def listed(n: int, rules: set[str]) -> str:
        quoted = (rule.replace("\\", "\\\\").replace("'", "\\'") for rule in sorted(rules))
        return f"{tail(n)} IN ({', '.join(f"'{rule}'" for rule in quoted)})"

    branches = [(listed(n + 1, excepted[n]), n) for n in sorted(excepted, reverse=True)]
    for n in sorted({*exact, *wildcard}, reverse=True):
        tests = [listed(n, exact[n])] if n in exact else []
        tests += [listed(n - 1, wildcard[n])] if n in wildcard else []
        branches.append((" OR ".join(tests), n))
    branches.append(("true", 1))
    whens = " ".join(
        f"WHEN {test} THEN CASE WHEN {tail(n)} <> h THEN {tail(n + 1)} END" for test, n in branches
    )
    empty_label = "startswith(h, '.') OR endswith(h, '.') OR contains(h, '..')"
    return f"CASE WHEN {empty_label} THEN NULL {whens} END"


def hosts_domains(
    hosts: Column, suffixes: Iterable[str], other: str | None = None
) -> Column:
    """Array of hosts -> array of their registrable domains, without those that have none.

    Entries that start with ``other`` are no hosts and stay as they are.
    """
    domain = _domain_sql(tuple(suffixes))
    if other is not None:
        domain = f"CASE WHEN startswith(h, '{other}') THEN h ELSE {domain} END"
    return F.array_compact(F.call_function("transform", hosts, F.expr(f"h -> {domain}")))


def url_domains(urls: Column, suffixes: Iterable[str]) -> Column:
    """Array of URLs -> array of their registrable domains, without those that have none."""
    return hosts_domains(F.transform(urls, url_host), suffixes)


def load_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Rules from a file in the public suffix list's own format (comments and blank lines skipped)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s")[0].alias("rule"))
    rules = lines.where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    # A list of rules is configuration: its size doesn't depend on the data.
    return tuple(row.rule.lower() for row in rules.toLocalIterator())
