"""The corpus pipeline: classifier, rules, near-duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller
may write and read again before the next one. All stages but the last return the
columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from rivulet.llm.classifier import score
from rivulet.llm.common import materialise, only_ids, table, without_ids
from rivulet.llm.minhash import near_duplicate_classes
from rivulet.llm.mixing import mix_sources
from rivulet.llm.quality_rules import quality_rules
from rivulet.llm.query_quality import THRESHOLD, trained
from rivulet.llm.query_tokens import digests
from rivulet.llm.sentencepiece_bpe import encode


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns beyond doc_id, text and source under names of our own, and how to name them back.

    Operators add columns; whatever a table calls its own, none of them meets one.
    """
    used = ("doc_id", "text", "source")
    names = {c: c if c in used else f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def _ordered(field: StructField) -> Column:
    """The column, or the JSON of its values where their type has no order."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(field.name)) if "map<" in kind or "variant" in kind else F.col(field.name)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above.

    Every row is scored by its whole text, however long. Null and empty texts get
    the score of an empty text; equal texts stay or go together. doc_id decides
    nothing but which rows are learned from, so null and repeated ones are
    judged like others. All columns are returned, whatever their names; an
    empty table gives an empty one.
    """
    rows, back = _plain(docs)
    weights = trained(docs, table(spark, sf_dir, "labels"))
    return score(rows, weights).where(F.col("score") >= THRESHOLD).select(*back)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules.

    Null, empty and blank texts have too few words and go. Very long texts are
    judged whole; equal rows stay or go together; doc_id plays no part. All
    columns are returned, whatever their names; an empty table gives an empty one.
    """
    rows, back = _plain(docs)
    return quality_rules(rows).where("kept").select(*back)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id.

    Of rows that share a doc_id one stays, the one with the smallest text (null
    first; then by the other columns). Rows with a null doc_id and texts
    without words are near to nothing and stay. Texts are compared whole,
    however long. All columns are returned, whatever their names; an empty
    table gives an empty one.
    """
    rows, back = _plain(docs)
    classes = near_duplicate_classes(rows.select("doc_id", "text"))
    others = materialise(classes.where("doc_id <> class_id").select("doc_id").distinct(), "others")
    repeated = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    kept = without_ids(rows, others, "doc_id")
    if not repeated.isEmpty():
        order = [_ordered(f) for f in rows.schema.fields if f.name not in ("doc_id", "text")]
        once = only_ids(kept, repeated, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), F.struct("text", *order)).alias("row"))
        once = once.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns])
        kept = without_ids(kept, repeated, "doc_id").unionByName(once)
    return kept.select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document that it takes twice is there twice.

    Null sources are one source. Texts without words are never taken; very long
    ones are taken whole or not at all. Rows equal in doc_id and text are taken alike, a null doc_id
    like any other. All columns are returned, whatever their names; an empty
    table gives an empty one.
    """
    rows, back = _plain(docs)
    taken = mix_sources(rows).where("copies > 0")
    return taken.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its ids and digests of the ids and of the text decoded from them.

    One row for each row, null and repeated doc_ids included. A null or empty
    text has no ids. Very long texts are encoded whole. Further columns, whatever
    their names, are left out; an empty table gives an empty one.
    """
    found = encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded", drop_text=True)
    return digests(found, "ids")


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("MinHash near-dedup", deduplicated),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]

#: Training, sampled signatures and merge rounds are beyond SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what passes from one to the next is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
