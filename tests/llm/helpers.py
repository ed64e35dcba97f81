"""Small frames for the operator tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark: SparkSession, texts: dict | list) -> DataFrame:
    """A documents table; a list of texts is numbered from 0, and of pairs as given."""
    rows = list(enumerate(texts)) if not texts or not isinstance(texts[0], tuple) else texts
    return spark.createDataFrame(
        [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], DOCUMENTS
    ).repartition(3)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
