"""Tokenises documents and writes them as token-id files in ascending doc_id order."""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import map_batches, materialise, scratch_path
from rivulet.llm.shared_files import open_folder
from rivulet.llm.tokenfile import Reader, Writer

#: Distinct chunks, and parts of chunks, that a Python worker remembers.
REMEMBERED = 500_000
#: Bytes of text in a file, and the characters by which rows of one doc_id are dealt to files.
FILE_BYTES, START = 256 << 20, 64

#: Latin letters that stand for themselves in every normal form, then ASCII marks other than the apostrophe.
_LETTERS_THEN_MARKS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-`{-~]*)")

_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letters that stand for bytes in byte-level vocabularies: printed ones for themselves, others from 256 on; line ends part words.
_BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED) if b != 10}


class ChunkEncoder:
    """Encodes whole texts chunk by chunk with a tokenizers file.

    A tokenizer whose tokens never hold white space gives the same ids for a
    text as for its chunks between ASCII white space, one after the other; a
    chunk met before is looked up. Another tokenizer, found out by a trial, and
    ``by_chunk=False`` encode whole texts instead.
    """

    def __init__(self, path: str, by_chunk: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.seen = Tokenizer.from_file(path), {}
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.parts: dict[str, bytes] = {}
        probe = "Ab, aB;\u00c9x? \u00e9X!"
        self.model = self.tokenizer.model
        self.cuts = self._whole(probe) == [i for part in ("ab", ",", "ab", ";", "\u00e9x", "?", "\u00e9x", "!") for i in self._whole(part)]
        self.direct = self._takes_words()
        cut = "ab  Cd\n e\t1"
        self.by_chunk = by_chunk and self._whole(cut) == [i for part in cut.split() for i in self._whole(part)]
        marks = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark_id, self.mark = (marks[0][0], marks[0][1].content) if marks else (None, None)

    @property
    def width(self) -> int:
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: list[bytes]) -> None:
        """Remembers the ids of new chunks.

        With a tokenizer that lowers case and cuts words from punctuation, a chunk
        of letters and then punctuation is looked up as those two parts.
        """
        texts = [c.decode() for c in chunks]
        cut = map(_LETTERS_THEN_MARKS.fullmatch, texts) if self.cuts else [None] * len(texts)
        parts = [("", t) if m is None else (m[1].lower(), m[2]) for t, m in zip(texts, cut, strict=True)]
        if len(self.parts) > REMEMBERED:
            self.parts = _first_half(self.parts)
        known = self.parts
        known[""] = b""
        words = [w for w in {w for w, _ in parts} if w not in known]
        rest = [t for t in {t for _, t in parts} if t not in known]
        if self.direct:
            known.update(zip(words, self._words(words), strict=True))
        else:
            rest = list({*rest, *words})
        for p, ids in zip(rest, self._ids(rest), strict=True):
            known[p] = ids.tobytes()  # far smaller than a list
        self.seen.update(zip(chunks, [known[w] + known[t] for w, t in parts], strict=True))

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of lower-case letters, which the library's model gets without the steps before it."""
        if not words:
            return []
        mapped = "\n".join(words).encode().decode("latin-1").translate(_BYTE_LETTERS).split("\n")
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in mapped]

    def _takes_words(self) -> bool:
        """Whether the model alone gives the same ids as the tokenizer for all letters of a word, one by one and in words."""
        if not self.cuts:
            return False
        letters = [c.lower() for c in map(chr, range(0x250)) if _LETTERS_THEN_MARKS.fullmatch(c)]
        probes = [*letters, *("".join(letters[k : k + 9]) for k in range(len(letters))), "the", "internationalisation"]
        try:
            return self._words(probes) == [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch(probes, add_special_tokens=False)]
        except Exception:  # a model without the byte letters
            return False

    def _ids(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk, from one call for all of them.

        A special token cuts a text wherever it stands, so the chunks are
        joined by one and the ids are cut at its id. Chunks that hold it
        themselves are encoded one by one.
        """
        if not chunks:
            return []
        if self.mark is None or any(self.mark in c for c in chunks):
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(chunks)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
        return [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the chunks of a batch are encoded together."""
        if not self.by_chunk:
            yield from (np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False))
            return
        if len(self.seen) > REMEMBERED:
            self.seen = _first_half(self.seen)
        split = [t.encode().split() for t in texts]
        chunks = list(itertools.chain.from_iterable(split))
        found = list(map(self.seen.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = list({chunks[k] for k in missing})
        for i in range(0, len(new), 16_384):
            self._learn(new[i : i + 16_384])
        for k in missing:
            found[k] = self.seen[chunks[k]]
        at = 0
        for part in split:
            yield np.frombuffer(b"".join(found[at : at + len(part)]), dtype=np.uint32)
            at += len(part)


def _first_half(known: dict) -> dict:
    """What was met first is what is met most often."""
    return dict(itertools.islice(known.items(), len(known) // 2))


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def worker_encoder(path: str, by_chunk: bool) -> ChunkEncoder:
    """This Python worker's encoder. Workers outlive tasks, and what one task learned serves the next."""
    if (path, by_chunk) not in _encoders:
        _encoders[path, by_chunk] = ChunkEncoder(path, by_chunk)
    return _encoders[path, by_chunk]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, partitions: int | None = None, text: str = "text", by_chunk: bool = True) -> DataFrame:
    """Writes one file for each range of doc_id and returns (file, path, first_id, n_docs, n_tokens).

    ``folder`` must be one that all executors share, given as a URI that pyarrow
    can open. Rows are dealt by doc_id to ``partitions`` ranges (by default of at
    most about FILE_BYTES of text) and sorted within
    them, nulls first; rows with the same doc_id are in the order of their
    texts, null and empty ones alike empty, also where they span files. Very long
    texts are encoded whole and fill a frame of their own. A retried task writes the
    same bytes to a new name and moves it over the old one. The result is
    written, so that reading it never writes the files again. Other columns are left
    aside, whatever their names; an empty table gives no files and an empty result.
    """
    spark = docs.sparkSession
    n = partitions
    if n is None:
        total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES), 1)
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, START)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        fs, root = open_folder(folder)
        encoder = worker_encoder(tokenizer, by_chunk)
        temporary, path = f"{root}/_{uuid.uuid4().hex}", f"{root}/part-{part:05d}.tok"
        tail, documents, tokens = np.array([] if end_id is None else [end_id], dtype=np.uint32), 0, 0
        with fs.open_output_stream(temporary) as out:
            writer = Writer(out, width=encoder.width)
            for batch in itertools.chain([first], batches):
                for at in range(0, batch.num_rows, 128):
                    piece = batch.slice(at, 128)
                    for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                        ids = np.concatenate([ids, tail])
                        writer.add(doc_id, ids)
                        documents, tokens = documents + 1, tokens + len(ids)
            writer.close()
        fs.move(temporary, path)
        yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int64()), "path": [path], "n_docs": pa.array([documents], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return materialise(map_batches(dealt, write, "file long, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, read back from the files.

    ``start`` counts the ids of all documents before. Only one row for each
    file, never one for each document, is summed up in a single task.
    """
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    n = max(files.count(), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as source:
                    start, found = row["base"], []
                    for _, doc_id, ids in Reader(source).documents():
                        found.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["file"]))
                        start += len(ids)
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                    yield _rows(found)

    return map_batches(placed.select("path", "base", "file").repartition(n), read, "doc_id long, start long, n_tokens long, ids_crc32 long, file long")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "file")
    columns = zip(*found, strict=True) if found else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(names))


def token_folder(spark) -> str:
    return scratch_path(spark, "token-output")
