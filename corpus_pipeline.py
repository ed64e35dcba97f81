"""The corpus pipeline: toxic documents go, near copies, repeated passages and benchmark passages follow, the rest is packed.

Every stage reads what its predecessor wrote to the session's shared folder, all rows and all columns of ``documents``;
the last one returns the pieces of the packed sequences. A lost executor costs at most a part of one stage.

1. ``toxicity``: documents that the clause grammar scores 0.5 or more go. Its lexicon and weights come from ``labels``.
2. ``near_duplicates``: of each class of near copies the document with the smallest doc_id stays.
3. ``substring_dedup``: words in 50-word windows that a smaller document also has are cut from the text; a document
   of which nothing is left goes.
4. ``decontamination``: documents that contain an item of ``benchmark`` go.
5. ``packing``: one row per piece, in sequences of at most 1024 tokens.

Cases: rows with a null text or doc_id pass the first four stages and are packed as empty texts, or under a null
id. An empty ``documents`` gives an empty result, an empty ``labels`` the model's prior weights, an empty
``benchmark`` takes nothing away. Extra columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curdline.llm import decontamination, near_duplicates, packing, substring_dedup, toxicity
from curdline.llm.tokens import tokenizer_spec
from curdline.sources.tables import materialized

TOKENIZER = "byte_bpe_50k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicated(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_spec(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: SQL cannot express the grammar's scores, the tiling or the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return docs
