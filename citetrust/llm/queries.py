"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citetrust.llm import oracle, oracle_trees
from citetrust.llm.bpe import encode_decode
from citetrust.llm.html_text import extract
from citetrust.llm.language import learn_and_identify
from citetrust.llm.merkle import audit
from citetrust.llm.mil import quality as mil_quality
from citetrust.llm.neighbours import nearest
from citetrust.llm.ngram_join import join
from citetrust.llm.packing import pack_documents
from citetrust.llm.quality_rules import quality as line_quality
from citetrust.llm.repeats import remove_repeats
from citetrust.llm.sharding import shards
from citetrust.llm.url_filter import RULES, judge
from citetrust.llm.trie import prefix_trie
from citetrust.llm.work import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, percent=90)


def op2_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return mil_quality(table(spark, sf_dir, "documents", "doc_id", "text"), labels)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_mil_quality,
        op3_url_filter,
        op4_bpe,
        op5_suffix_dedup,
        op6_language,
        op7_extendible_shards,
        op8_line_rules,
        op9_neighbours,
        op10_best_two_fit,
        op11_merkle_manifest,
        op12_html_extraction,
        op13_prefix_trie,
    )
}
ORACLE = {
    "op1_ngram_join": oracle.NGRAM_JOIN,
    "op3_url_filter": oracle.URL_FILTER,
    "op8_line_rules": oracle.LINE_RULES,
    "op11_merkle_manifest": oracle_trees.merkle(),
    "op13_prefix_trie": oracle_trees.trie(),
}
