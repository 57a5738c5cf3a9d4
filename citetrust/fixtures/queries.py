"""Every operator as a query over the derived revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrust.fixtures.dumps import write_dump
from citetrust.fixtures.tables import (
    BLOCK_TEMPLATE,
    INLINE_TEMPLATE,
    PAGE_OF_RUN,
    SUFFIXES,
    given_table,
    revisions,
)
from citetrust.functions import text as t
from citetrust.functions.domains import url_domains
from citetrust.functions.vectors import is_undecided, occurrence_weight
from citetrust.operators import diagnostics, source_stats
from citetrust.operators.labels import before_split, from_split, labels, mask_labels
from citetrust.operators.pairing import block_pairs, inline_pairs, pairs_to_revisions
from citetrust.operators.scoring import rounded_scores, score
from citetrust.plans import jobs
from citetrust.session import scratch_folder
from citetrust.sources import tables
from citetrust.sources.dump import dump_block_pairs, dump_inline_pairs

Query = Callable[[SparkSession, str], DataFrame]


def _joined(src: str) -> Column:
    return F.array_join(F.array_sort(src), " ")


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "page_id",
        "rev_id_ta",
        "rev_id_tr",
        _joined("src_ta").alias("src_ta"),
        _joined("src_tr").alias("src_tr"),
    )


def _flat_revisions(revs: DataFrame) -> DataFrame:
    return revs.withColumn("src", _joined("src"))


def _numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    decimals = [c for c, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_pairs(revisions(spark, sf_dir), BLOCK_TEMPLATE, SUFFIXES)


def _split(spark: SparkSession, sf_dir: str) -> Column:
    """Revision id that leaves about 70 % of the revisions before it."""
    events = given_table(spark, sf_dir, "events")
    return events.select(F.floor(F.max("event_id") * 7 / 10).cast("bigint").alias("split")).scalar()


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs before the split, and the revisions of the pairs from it on."""
    pairs, split = _pairs(spark, sf_dir), _split(spark, sf_dir)
    return before_split(pairs, split), pairs_to_revisions(from_split(pairs, split))


def _estimates(found: DataFrame) -> DataFrame:
    return source_stats.rounded(source_stats.with_votes(found))


def _text_query(extract: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract(F.col("text"))
        return revisions(spark, sf_dir).select("rev_id", F.explode(found).alias("src"))

    return query


def _estimate_query(estimate: Callable[[DataFrame], DataFrame], of_revisions: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir)
        return _numbers(_estimates(estimate(pairs_to_revisions(pairs) if of_revisions else pairs)))

    return query


def _score_query(combiner: str, clean: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _train_test(spark, sf_dir)
        estimates = _estimates(source_stats.estimate_from_changes(train))
        scored = score(test, estimates, combiner, clean)
        return _numbers(rounded_scores(scored))

    return query


def template_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).select(
        "rev_id",
        t.template_present(F.col("text"), BLOCK_TEMPLATE).alias("block"),
        t.template_present(F.col("text"), INLINE_TEMPLATE).alias("inline"),
    )


def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given URLs, as they are and mangled the way wikitext mangles them."""
    pages = given_table(spark, sf_dir, "pages")
    url = F.col("url")
    rest = F.regexp_replace(url, "^https?://", "")
    forms = {
        "plain": url,
        "upper": F.upper(url),
        "brackets": F.concat(F.lit("  "), url, F.lit(" }} ")),
        "paren": F.concat(F.lit("http://"), F.substring_index(rest, "/", 1), F.lit(")")),
        "piped": F.concat(F.lit("http://"), F.substring_index(rest, "/", 1), F.lit("|title=x")),
        "user_port": F.concat(F.lit("ftp://me:pw@"), F.substring_index(rest, "/", 1), F.lit(":21")),
        "template": F.concat(url, F.lit("{{dead}}x")),
        "no_scheme": rest,
        "wildcard": F.concat(F.lit("https://a.b"), "page_id", F.lit(".ck/x")),
        "exception": F.concat(F.lit("https://sub"), "page_id", F.lit(".www.ck?x")),
        "suffix_only": F.lit("http://co.uk/"),
        "deep": F.concat(F.lit("http://x.y.s"), "page_id", F.lit(".sch.uk#f")),
        "one_label": F.lit("http://localhost:8080/"),
        "empty_label": F.lit("http://a..com/"),
    }
    variants = F.array(
        *[F.struct(F.lit(k).alias("form"), v.alias("link")) for k, v in forms.items()]
    )
    return pages.select("page_id", F.inline(variants)).select(
        "page_id", "form", F.get(url_domains(F.array("link"), SUFFIXES), F.lit(0)).alias("domain")
    )


def cleanup_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.ref_urls(F.col("text"), SUFFIXES)
    return (
        revisions(spark, sf_dir)
        .select("rev_id", F.explode(found).alias("src"))
        .select("rev_id", "src", t.cleanup_source(F.col("src")).alias("cleaned"))
    )


def pairs_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_pairs(_pairs(spark, sf_dir))


def pairs_block_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs from a history whose positions lie far apart, as time stamps do."""
    sparse = revisions(spark, sf_dir).withColumn("pos", F.col("pos") * 2**20)
    return _flat_pairs(block_pairs(sparse, BLOCK_TEMPLATE, SUFFIXES))


def pairs_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_pairs(inline_pairs(revisions(spark, sf_dir), INLINE_TEMPLATE, SUFFIXES))


def written_dump(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_folder(spark)
    write_dump(revisions(spark, sf_dir, PAGE_OF_RUN), folder)
    return folder


def pairs_of_dump(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_pairs(dump_block_pairs(spark, folder, BLOCK_TEMPLATE, SUFFIXES))


def dump_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_dump(spark, written_dump(spark, sf_dir))


def dump_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dump_block_pairs(spark, written_dump(spark, sf_dir), BLOCK_TEMPLATE, SUFFIXES)
    return _flat_revisions(pairs_to_revisions(found))


def jobs_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump to stored pairs to stored estimates to stored scores, each job reading the last one's files."""
    data = scratch_folder(spark)
    (split,) = spark.range(1).select(_split(spark, sf_dir)).first()
    pairs = jobs.parse_pairs(spark, data, written_dump(spark, sf_dir), BLOCK_TEMPLATE, suffixes=SUFFIXES)
    probs = jobs.evaluate_pair_sources(spark, data, pairs, BLOCK_TEMPLATE, split)
    scores = jobs.evaluate_pair_revisions(spark, data, pairs, probs, BLOCK_TEMPLATE, split)
    return _stored_scores(spark, scores)


def _stored_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as they stand in the files: four decimals, or NaN."""
    schema = "revision_id bigint, p_added string, p_removed string"
    return spark.read.schema(schema).option("header", True).csv(folder)


def dump_pairs_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dump_inline_pairs(spark, written_dump(spark, sf_dir), INLINE_TEMPLATE, SUFFIXES)
    return _flat_pairs(found)


def pairs_to_revisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_revisions(pairs_to_revisions(_pairs(spark, sf_dir)))


def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_pairs(_train_test(spark, sf_dir)[0])


def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_revisions(_train_test(spark, sf_dir)[1])


def labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    tables.write_labels(labels(pairs_to_revisions(_pairs(spark, sf_dir))), folder)
    schema = "revision_id bigint, pair_id bigint, templateAdded string, templateRemoved string"
    return spark.read.schema(schema).option("header", True).csv(folder)


def mask_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    revs = pairs_to_revisions(_pairs(spark, sf_dir))
    return _flat_revisions(mask_labels(revs, _split(spark, sf_dir)))


def pairs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    tables.write_pairs(_pairs(spark, sf_dir), folder)
    return _flat_pairs(tables.read_pairs(spark, folder))


def revisions_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked revisions, stored, and read with and without their ground truth."""
    folder = scratch_folder(spark)
    revs = pairs_to_revisions(_pairs(spark, sf_dir))
    tables.write_revisions(mask_labels(revs, _split(spark, sf_dir)), folder)
    reads = [
        _flat_revisions(tables.read_revisions(spark, folder, truth)).withColumn("gt", F.lit(truth))
        for truth in (True, False)
    ]
    return reads[0].unionByName(reads[1])


def source_probs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    found = _estimates(source_stats.estimate_from_changes(_pairs(spark, sf_dir)))
    tables.write_source_probs(found, folder)
    stored = tables.read_source_probs(spark, folder)
    return stored.withColumns({c: F.round(c, 4) for c in ("p_added", "p_removed")})


def source_probs_unchanged_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way estimates, stored, and read as the two-way estimates scoring uses."""
    folder = scratch_folder(spark)
    found = _estimates(source_stats.estimate_with_unchanged(_pairs(spark, sf_dir)))
    tables.write_source_probs(found, folder)
    stored = tables.read_source_probs(spark, folder)
    return stored.withColumns({c: F.round(c, 4) for c in ("p_added", "p_removed")})


def revision_probs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    train, test = _train_test(spark, sf_dir)
    estimates = _estimates(source_stats.estimate_from_changes(train))
    tables.write_revision_probs(rounded_scores(score(test, estimates, "multiplicative")), folder)
    return _stored_scores(spark, folder)


def occurrence_weight_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_stats.estimate_from_revisions(pairs_to_revisions(_pairs(spark, sf_dir)))
    weight = F.round(occurrence_weight(F.col("occurrences")), 6)
    return found.select("src", "occurrences", weight.alias("weight"))


def is_undecided_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_stats.estimate_from_revisions(pairs_to_revisions(_pairs(spark, sf_dir)))
    undecided = is_undecided(F.col("p_added"), F.col("p_removed"))
    return found.select("src", undecided.alias("undecided"))


def score_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled revisions on both sides: estimates from those before the split, scores from it on."""
    revs = pairs_to_revisions(_pairs(spark, sf_dir))
    split = _split(spark, sf_dir)
    train = before_split(revs, split, "revision_id")
    estimates = _estimates(source_stats.estimate_from_revisions(train))
    scored = score(from_split(revs, split, "revision_id"), estimates)
    return _numbers(rounded_scores(scored))


def count_source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.count_source_changes(_pairs(spark, sf_dir))


def count_unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    estimates = _estimates(source_stats.estimate_from_changes(train))
    found = diagnostics.count_unknown_sources(test, estimates)
    return found.withColumns({c: F.round(c, 6) for c in ("percentage", "mean_unknown_share")})


QUERIES: dict[str, Query] = {
    "dump_pairs": dump_pairs,
    "dump_pairs_inline": dump_pairs_inline,
    "dump_revisions": dump_revisions,
    "jobs_end_to_end": jobs_end_to_end,
    "template_present": template_present,
    "registrable_domain": registrable_domain,
    "src_ref_urls": _text_query(lambda c: t.ref_urls(c, SUFFIXES)),
    "src_cite_urls": _text_query(lambda c: t.cite_urls(c, SUFFIXES)),
    "src_isbns": _text_query(t.isbns),
    "src_inline": _text_query(lambda c: t.inline_sources(c, INLINE_TEMPLATE, SUFFIXES)),
    "extract_sources": _text_query(lambda c: t.extract_sources(c, SUFFIXES)),
    "cleanup_source": cleanup_source,
    "pairs_block": pairs_block,
    "pairs_block_rare": pairs_block_rare,
    "pairs_inline": pairs_inline,
    "pairs_to_revisions": pairs_to_revisions_query,
    "train_split": train_split,
    "test_split": test_split,
    "labels": labels_query,
    "mask_labels": mask_labels_query,
    "pairs_roundtrip": pairs_roundtrip,
    "revisions_roundtrip": revisions_roundtrip,
    "source_probs_roundtrip": source_probs_roundtrip,
    "source_probs_unchanged_roundtrip": source_probs_unchanged_roundtrip,
    "revision_probs_roundtrip": revision_probs_roundtrip,
    "source_eval_revisions": _estimate_query(source_stats.estimate_from_revisions, True),
    "source_eval_pairs": _estimate_query(source_stats.estimate_from_pairs),
    "source_eval_changed": _estimate_query(source_stats.estimate_from_changes),
    "source_eval_with_unchanged": _estimate_query(source_stats.estimate_with_unchanged),
    "occurrence_weight": occurrence_weight_query,
    "is_undecided": is_undecided_query,
    "combine_multiplicative": _score_query("multiplicative"),
    "combine_logarithmic": _score_query("logarithmic"),
    "combine_weighted": _score_query("weighted"),
    "combine_weighted_sure": _score_query("weighted_sure", clean=True),
    "score_pairs": _score_query("weighted_sure"),
    "score_revisions": score_revisions,
    "count_source_changes": count_source_changes,
    "count_unknown_sources": count_unknown_sources,
}
