"""Token-id files: independent zstandard frames with a trailing seek table.

Layout of one file, all numbers little-endian::

    magic   8 bytes  b"RVLTTOK1"
    frames  each frame is one zstandard frame of the token ids of some
            documents, as unsigned integers of the file's width, one document
            after the other
    index   one zstandard frame: int64 arrays doc_ids, n_tokens (one
            number for each document), and a byte array of null doc_ids
    table   one row of 6 uint64 for each frame: offset, bytes, first document,
            documents, tokens, crc32 of the uncompressed ids
    footer  uint64 offset and bytes of the index, offset of the table, number of
            frames, number of documents, width in bytes, crc32 of index and
            table; then the magic again

A reader fetches the footer, the table and the index, and then only the frames
of the documents it wants; each frame is checked against its checksum.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import zstandard

MAGIC = b"RVLTTOK1"
_FOOTER = struct.Struct("<7Q8s")
FRAME_TOKENS = 1 << 18


class Writer:
    """Writes documents in the given order; holds one frame in memory, and 17 bytes for each document of the file."""

    def __init__(self, out: BinaryIO, width: int = 4, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.out, self.dtype, self.frame_tokens = out, np.dtype(f"<u{width}"), frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.at, self.rows, self.ids = 0, [], []
        self.counts, self.doc_ids, self.nulls = array("q"), array("q"), bytearray()
        self.pending = self.first = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.ids.append(np.asarray(ids, dtype=self.dtype))
        self.pending += len(ids)
        if self.pending >= self.frame_tokens:
            self._frame()

    def _frame(self) -> None:
        if self.first == len(self.counts):
            return
        raw = np.concatenate(self.ids).tobytes()
        packed = self.compressor.compress(raw)
        self.rows.append((self.at, len(packed), self.first, len(self.counts) - self.first, self.pending, zlib.crc32(raw)))
        self._write(packed)
        self.ids, self.pending, self.first = [], 0, len(self.counts)

    def close(self) -> None:
        self._frame()
        index = self.compressor.compress(np.array(self.doc_ids, dtype="<i8").tobytes() + np.array(self.counts, dtype="<i8").tobytes() + bytes(self.nulls))
        table = np.array(self.rows, dtype="<u8").reshape(-1, 6).tobytes()
        at = self.at
        self._write(index)
        self._write(table)
        self._write(_FOOTER.pack(at, len(index), at + len(index), len(self.rows), len(self.counts), self.dtype.itemsize, zlib.crc32(index + table), MAGIC))


class Reader:
    """Reads a file that can seek. ``bytes_read`` counts what was fetched."""

    def __init__(self, source: BinaryIO):
        self.source, self.bytes_read = source, 0
        end = source.seek(0, 2)
        at, size, table_at, frames, documents, width, crc, magic = _FOOTER.unpack(self._get(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        tail = self._get(at, size + 48 * frames)
        if zlib.crc32(tail) != crc:
            raise ValueError("the index is damaged")
        self.dtype = np.dtype(f"<u{width}")
        self.frames = np.frombuffer(tail[size:], dtype="<u8").reshape(-1, 6).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(tail[:size])
        self.counts = np.frombuffer(raw, dtype="<i8", count=documents, offset=8 * documents)
        nulls = raw[16 * documents :]
        self.ids, self.nulls = np.frombuffer(raw, dtype="<i8", count=documents), np.frombuffer(nulls, dtype=np.uint8)

    def doc_id(self, position: int) -> int | None:
        return None if self.nulls[position] else int(self.ids[position])

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        self.bytes_read += size
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        at, size, _, _, tokens, crc = (int(x) for x in self.frames[k])
        raw = zstandard.ZstdDecompressor().decompress(self._get(at, size))
        if zlib.crc32(raw) != crc or len(raw) != tokens * self.dtype.itemsize:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, dtype=self.dtype)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(position, doc_id, ids) of the documents at the wanted positions, or of all."""
        chosen = None if wanted is None else np.unique(np.fromiter(wanted, dtype=np.int64))
        for k, (_, _, first, n, _, _) in enumerate(self.frames):
            at = np.arange(first, first + n) if chosen is None else chosen[(chosen >= first) & (chosen < first + n)]
            if not len(at):
                continue
            ids = self.frame(k)
            starts = np.concatenate([[0], np.cumsum(self.counts[first : first + n])])
            for i in at:
                yield int(i), self.doc_id(i), ids[starts[i - first] : starts[i - first + 1]]
