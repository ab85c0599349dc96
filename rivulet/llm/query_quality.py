"""Query of the quality classifier over ``documents``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.classifier import fit, held_out, score
from rivulet.llm.common import table

THRESHOLD = 0.3


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fold."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label")).where("label IS NOT NULL")
    return documents.select("doc_id", "text").join(known, "doc_id")


def trained(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    return fit(training_rows(documents, labels))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
