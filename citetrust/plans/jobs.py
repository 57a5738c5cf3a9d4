"""The jobs from dump to scores. Each reads stored artifacts, and writes one or returns a one-row result.

Artifacts live in a data folder under names made of kind, template and UTC time; every job that writes
returns the folder it wrote. Folders may be on any file system Spark can reach.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from citetrust.functions.text import template_slug
from citetrust.operators import diagnostics, source_stats
from citetrust.operators.labels import before_split, from_split, labels, mask_labels
from citetrust.operators.pairing import pairs_to_revisions
from citetrust.operators.scoring import rounded_scores, score
from citetrust.session import scratch
from citetrust.sources import tables
from citetrust.sources.dump import dump_block_pairs, dump_inline_pairs


def artifact(data_folder: str, kind: str, template: str) -> str:
    stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H-%M-%SZ")
    return f"{data_folder.rstrip('/')}/{kind}-{template}-{stamp}"


def _parse(
    spark: SparkSession, dump_folder: str, template: str, inline: bool, suffixes: Iterable[str], folder: str
) -> DataFrame:
    read = dump_inline_pairs if inline else dump_block_pairs
    return read(spark, dump_folder, template, suffixes, scratch=folder)


def parse_pairs(
    spark: SparkSession,
    data_folder: str,
    dump_folder: str,
    template: str,
    inline: bool = False,
    *,
    suffixes: Iterable[str],
) -> str:
    """Dump -> revision pairs."""
    out = artifact(data_folder, "revision-pairs", template_slug(template))
    with scratch(spark) as folder:
        tables.write_pairs(_parse(spark, dump_folder, template, inline, suffixes, folder), out)
    return out


def parse_revisions(
    spark: SparkSession,
    data_folder: str,
    dump_folder: str,
    template: str,
    inline: bool = False,
    *,
    suffixes: Iterable[str],
) -> str:
    """Dump -> the two labelled revisions of every pair."""
    out = artifact(data_folder, "revisions", template_slug(template))
    with scratch(spark) as folder:
        pairs = _parse(spark, dump_folder, template, inline, suffixes, folder)
        tables.write_revisions(pairs_to_revisions(pairs), out)
    return out


def extract_labels(spark: SparkSession, data_folder: str, revisions: str, template: str) -> str:
    """Revisions -> label file."""
    out = artifact(data_folder, "labels", template_slug(template))
    tables.write_labels(labels(tables.read_revisions(spark, revisions)), out)
    return out


def extract_pair_labels(
    spark: SparkSession, data_folder: str, pairs: str, template: str, single_file: bool = False
) -> str:
    """Pairs -> label file of their revisions."""
    out = artifact(data_folder, "labels", template_slug(template))
    found = labels(pairs_to_revisions(tables.read_pairs(spark, pairs)))
    tables.write_labels(found, out, single_file)
    return out


def mask_data(
    spark: SparkSession, data_folder: str, revisions: str, split: int, template: str
) -> str:
    """Revisions -> the same without working labels from the split on."""
    out = artifact(data_folder, "revisions-masked", template)
    known = tables.read_revisions(spark, revisions, has_ground_truth=False)
    tables.write_revisions(mask_labels(known, split), out)
    return out


def _store_estimates(estimates: DataFrame, out: str, single_file: bool = False) -> str:
    voted = source_stats.with_votes(estimates)
    tables.write_source_probs(source_stats.rounded(voted), out, single_file)
    return out


def evaluate_sources(
    spark: SparkSession, data_folder: str, revisions: str, template: str, split: int | None = None
) -> str:
    """Labelled revisions before the split -> source estimates."""
    train = before_split(tables.read_revisions(spark, revisions), split, "revision_id")
    out = artifact(data_folder, "source-probabilities", template_slug(template))
    return _store_estimates(source_stats.estimate_from_revisions(train), out)


def evaluate_pair_sources(
    spark: SparkSession,
    data_folder: str,
    pairs: str,
    template: str,
    split: int | None = None,
    single_file: bool = False,
) -> str:
    """Pairs before the split -> source estimates from changed sources only."""
    train = before_split(tables.read_pairs(spark, pairs), split)
    out = artifact(data_folder, "sources-noUnchanged-probabilities", template_slug(template))
    return _store_estimates(source_stats.estimate_from_changes(train), out, single_file)


def evaluate_pair_sources_with_unchanged(
    spark: SparkSession, data_folder: str, pairs: str, template: str, split: int | None = None
) -> str:
    """Pairs before the split -> three-way source estimates."""
    train = before_split(tables.read_pairs(spark, pairs), split)
    out = artifact(data_folder, "source-pair-wU-probabilities", template_slug(template))
    return _store_estimates(source_stats.estimate_with_unchanged(train), out)


def evaluate_revisions(
    spark: SparkSession,
    data_folder: str,
    revisions: str,
    source_probs: str,
    template: str,
    split: int | None = None,
    combiner: str = "weighted_sure",
) -> str:
    """Revisions from the split on + source estimates -> revision scores."""
    scored = from_split(tables.read_revisions(spark, revisions), split, "revision_id")
    estimates = tables.read_source_probs(spark, source_probs)
    out = artifact(data_folder, "probabilities", template_slug(template))
    tables.write_revision_probs(rounded_scores(score(scored, estimates, combiner)), out)
    return out


def evaluate_pair_revisions(
    spark: SparkSession,
    data_folder: str,
    pairs: str,
    source_probs: str,
    template: str,
    split: int | None = None,
    combiner: str = "weighted_sure",
    clean: bool = False,
) -> str:
    """Pairs from the split on + source estimates -> scores of both their revisions."""
    scored = pairs_to_revisions(from_split(tables.read_pairs(spark, pairs), split))
    estimates = tables.read_source_probs(spark, source_probs)
    out = artifact(data_folder, "probabilities-sure-0.0", template_slug(template))
    tables.write_revision_probs(rounded_scores(score(scored, estimates, combiner, clean)), out)
    return out


def count_source_changes(spark: SparkSession, pairs: str) -> DataFrame:
    """Pairs -> how many change their sources."""
    return diagnostics.count_source_changes(tables.read_pairs(spark, pairs))


def count_unknown_sources(
    spark: SparkSession, pairs: str, source_probs: str, split: int | None = None
) -> DataFrame:
    """Pairs from the split on + source estimates -> coverage of their revisions."""
    checked = pairs_to_revisions(from_split(tables.read_pairs(spark, pairs), split))
    return diagnostics.count_unknown_sources(checked, tables.read_source_probs(spark, source_probs))
