"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Training reads a bounded sample of labelled documents. The sample is dealt by a
hash of the document number to a fixed number of shards; each shard trains one
model by follow-the-regularised-leader, one document at a time, and the shards'
weights are averaged. A model is one array of 2 ** bits numbers, whatever the
corpus. Scores are dot products of the text's sparse features with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import map_batches
from rivulet.llm.words import WordHashes, give_back, mixed, ngrams, texts_of

BITS = 18
SHARDS = 4
#: A model is fitted on at most about so many labelled documents.
MAX_TRAINING_ROWS = 12_000


#: Features are this long together, so that a few weights can settle a text.
SCALE = 4.0
_SHAPES = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
_SAME, _OTHER = np.uint64(0x5A4E), np.uint64(0x07E2)


class WordShapes(WordHashes):
    """Hash of a word's shape: letters, capitals and digits as classes, runs cut to one."""

    def hash(self, word: bytes) -> int:
        shape = re.sub(r"(.)\1+", r"\1\1", "".join("a" if c.islower() else "A" if c.isupper() else c for c in word.decode("utf-8", "replace").translate(_SHAPES)))
        return xxhash.xxh64_intdigest(shape.encode(), seed=1)


def features(text: bytes, words: WordHashes, shapes: WordShapes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and values of a text's n-grams, plus a slot that is always on.

    The n-grams are words and word pairs, shapes of words and of pairs, and
    whether a word repeats the one before. Values are square roots of counts,
    scaled to one length; texts of any length score alike.
    """
    split = text.split()
    hashes = np.array([words[w] for w in split], dtype=np.uint64)
    forms = np.array([shapes[w] for w in split], dtype=np.uint64)
    repeats = mixed(np.where(hashes[1:] == hashes[:-1], _SAME, _OTHER))
    grams = np.concatenate([ngrams(hashes, 1), ngrams(hashes, 2), ngrams(forms, 1), ngrams(forms, 2), mixed(repeats)])
    slots, counts = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts)
    if len(slots):
        values = values * (SCALE / np.sqrt(counts.sum()))
    return np.append(slots, 1 << bits), np.append(values, 1.0)


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss."""

    def __init__(self, size: int, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(pdf: pd.DataFrame, bits: int, epochs: int) -> pd.DataFrame:
    words, shapes, model = WordHashes(), WordShapes(), Ftrl((1 << bits) + 1)
    pdf = pdf.sort_values(["_order", "text", "label"], kind="stable", na_position="first")
    rows = [(*features((t or "").encode(), words, shapes, bits), int(y)) for t, y in zip(pdf["text"], pdf["label"], strict=True)]
    for _ in range(epochs):
        for at, x, label in rows:
            model.learn(at, x, label)
    w = model.weights().astype(np.float32)
    n = len(rows)
    del rows
    give_back()
    return pd.DataFrame({"n": [n], "w": [w.tobytes()]})


def fit(labelled: DataFrame, bits: int = BITS, shards: int = SHARDS, epochs: int = 3, max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray:
    """Weights from ``labelled`` (doc_id, text, label); null labels are left out.

    ``labelled`` should be cheap to count without its texts. Above ``max_rows``
    a sample is drawn by a hash of doc_id, the same on every run. doc_id only
    decides the sample, the shard and the order. No labelled rows give zeros.
    """
    known = labelled.where("label IS NOT NULL")
    n = known.select("doc_id").count()
    part = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    if n > max_rows:
        known = known.where(F.pmod(part, F.lit(1_000_000)) < int(max_rows * 1_000_000 / n))
    dealt = known.select("text", F.col("label").cast("int").alias("label"), part.alias("_order"), F.pmod(F.floor(part / 2**20).cast("bigint"), F.lit(shards)).alias("_shard"))
    models = dealt.groupBy("_shard").applyInPandas(lambda pdf: _train(pdf, bits, epochs), "n long, w binary").collect()  # `shards` rows at most
    if not models:
        return np.zeros((1 << bits) + 1, dtype=np.float32)
    return np.average([np.frombuffer(m["w"], dtype=np.float32) for m in models], axis=0, weights=[m["n"] for m in models]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Every row of ``docs`` with ``out``, a score between 0 and 1.

    The score depends on the text alone: null and empty texts have no words and
    get the score of the slot that is always on. Very long texts count whole.
    Other columns stay as they are, save one named like ``out``; repeated rows
    score alike; an empty table gives an empty result.
    """
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes, w = WordHashes(), WordShapes(), sent.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(texts_of(batch.column(keep.index(text)))):
                at, x = features(t, words, shapes, bits)
                scores[i] = 1.0 / (1.0 + np.exp(-np.clip(w[at].astype(np.float64) @ x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*keep, out])

    return map_batches(docs.select(*[f"`{c}`" for c in keep]), scored, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """True for rows whose crc32(doc_id as text) is a multiple of ``folds``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def python_held_out(doc_id: int, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0
