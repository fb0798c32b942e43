"""One query per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam,
    html_main,
    metric_join,
    mixture,
    near_dup,
    prefix_trie,
    quality,
    secrets,
    substrings,
    tokens,
    toxicity,
    urls,
    whitening,
)
from .common import saved
from .oracle import ORACLES

# Fixed values of the contract.
URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("key")


def op2_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.drop("key")


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary)


def op7_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.drop("key", "kept_text")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = saved(mixture.mixed_documents(_table(spark, sf_dir, "documents")), "mix")
    first = F.element_at("positions", 1)
    read = mix.withColumn("position", F.when(F.size("positions") > 0, first))
    return (
        read.repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op9_url_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).drop("score")


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learned_lexicon(documents, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(documents, lexicon)


def op11_character_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_contour_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: query
        for name, query in globals().items()
        if name.startswith("op") and name[2:3].isdigit()
    }


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in queries() if name in ORACLES}
