"""Query of embedding near-duplicates over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import table
from rivulet.llm.embedding_dedup import near_duplicates


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
