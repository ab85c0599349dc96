"""Queries over tokenised ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import table
from rivulet.llm.sentencepiece_bpe import encode
from rivulet.llm.token_counts import UnigramModel, count_tokens, estimate
from rivulet.llm.token_output import read_token_files, token_folder, write_token_files

END_ID = 2


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents."""
    joined = F.array_join("ids", ",").cast("binary")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded", drop_text=True))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_folder(spark)
    files = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_token_files(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = estimate(docs, UnigramModel.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model")))
    return count_tokens(docs, model, keep_text=False)
