"""Queries over the driver tables, one for each corpus operator, on whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curdline.llm import (
    chat,
    collocations,
    decontamination,
    kd_sharding,
    licenses,
    line_dedup,
    near_duplicates,
    oracle,
    orc_tokens,
    packing,
    source_audit,
    spot_signatures,
    substring_dedup,
    toxicity,
)
from curdline.llm.tokens import tokenizer_spec
from curdline.sources.tables import shared_folder

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_clause_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op2_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.sharded(_table(spark, sf_dir, "documents"))


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.digests(_table(spark, sf_dir, "documents"))


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op5_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    return chat.digests(chat.examples(rows.union(planted)))


def op6_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.labelled(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_spec(public_tokenizers.path(TOKENIZER)))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/curdline/{uuid.uuid4().hex}/token_ids.orc"
    orc_tokens.write(_table(spark, sf_dir, "documents"), tokenizer_spec(public_tokenizers.path(TOKENIZER)), path)
    return orc_tokens.checksums(orc_tokens.read(spark, path))


def op11_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op12_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_source_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audited(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licence_sentences": oracle.licences_sql(), "op5_prefix_target_chat": oracle.CHAT,
        "op11_levelled_line_runs": oracle.LINES, "op12_trie_collocations": oracle.PHRASES,
        "op13_source_divergence_cube": oracle.SOURCES,
    }
