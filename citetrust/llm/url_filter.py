"""URL rules by host suffix and path prefix, looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8  # hexadecimal digits of the digest that are joined on

# The rules of the query (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://``, host (A-Z in lower case) up to ``/ ? #``, path then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url); rules (host, path, verdict).

    A rule fits its host and all subdomains, if the url's path starts with the rule's. Of several the longest (host
    and path together) wins, then the one with the longer host, then block. No rule: ``rule`` is null and the verdict
    is ``default``. A null url or one without ``://`` has an empty host and path. Null page ids stay null, repeated
    rows are judged each, other columns are not read. Rules with null fields or an empty host fit nothing.

    Each distinct (host, path) is expanded only into host suffixes and path prefixes of the shapes (number of labels,
    length of path) that rules have. These shapes are all that is collected: two small numbers for each kind of rule.
    Expressions meet the rules by the first PREFIX digits of their digests alone, for which the rules are gathered in
    one row each; the whole digest is confirmed in that row. Urls without a host take no part in the join.
    """
    rules = rules.select(
        F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).where("rule_host != '' and rule_path is not null and rule_verdict is not null").distinct()
    rules = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path")))
    length = (F.length("rule_host") + F.length("rule_path")).alias("length")
    known = F.struct(
        length,
        F.length("rule_host").alias("host_length"),
        F.col("rule_verdict").alias("verdict"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_digest").alias("digest"),
    )
    short = F.substring("rule_digest", 1, PREFIX).alias("short")
    listed = rules.groupBy(short).agg(F.collect_list(known).alias("rules"))
    labels = F.size(F.split("rule_host", "\\."))
    shapes = [tuple(r) for r in rules.select(labels, F.length("rule_path")).distinct().collect()]

    host, path = split_url(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = read.where("host != ''").select("host", "path").distinct()
    expressions = F.array(
        *[
            F.when(
                (F.size(F.split("host", "\\.")) >= n) & (F.length("path") >= k),
                F.struct(
                    F.substring_index("host", ".", -n).alias("suffix"), F.substring("path", 1, k).alias("prefix")
                ),
            )
            for n, k in sorted(shapes)
        ]
        or [F.lit(None).cast("struct<suffix:string,prefix:string>")]
    )
    expanded = urls.select("host", "path", F.explode(F.filter(expressions, lambda x: x.isNotNull())).alias("e"))
    whole = digest(F.col("e.suffix"), F.col("e.prefix"))
    expanded = expanded.select("host", "path", whole.alias("digest"), F.substring(whole, 1, PREFIX).alias("short"))
    confirmed = F.filter("rules", lambda rule: rule["digest"] == F.col("digest"))
    met = expanded.join(listed, "short").select("host", "path", F.array_max(confirmed).alias("best")).where("best is not null")
    hits = met.groupBy("host", "path").agg(F.max("best").alias("best"))
    judged = read.where("host != ''").join(hits, ["host", "path"], "left")
    return judged.unionByName(read.where("host = ''"), allowMissingColumns=True).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )

