"""Words and their hashes for Arrow batches of whole texts."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: What mixed() multiplies by.
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Rows that a Python worker turns into Python values at once.
ROWS_AT_ONCE = 256

Batches = Iterator[pa.RecordBatch]


def in_slices(function: Callable[[Batches], Batches], rows: int = ROWS_AT_ONCE) -> Callable[[Batches], Batches]:
    """The same function over small slices of the batches.

    A batch can hold ten thousand whole texts; as Python values they would take
    several times its size. At the end of a task its memory goes back to the
    system, because the worker lives on and serves other tasks.
    """

    def run(batches: Batches) -> Batches:
        set_aside()
        try:
            yield from function(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            give_back()

    return run


_set_aside: list[int] = []


def set_aside() -> None:
    """Once in each process, before it holds any rows: what is loaded by then is not searched for garbage after every task.

    A search through all modules takes longer than a small task.
    """
    if _set_aside != [os.getpid()]:
        gc.collect()
        gc.freeze()
        _set_aside[:] = [os.getpid()]


def give_back() -> None:
    """Returns what Python and Arrow have freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def texts_of(column: pa.Array) -> list[bytes]:
    """Every text as UTF-8 bytes; a null text counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of a word given as bytes; remembers a bounded number of short words."""

    LIMIT, LONG = 60_000, 64

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def hash(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
        # bytes.split() cuts at exactly the six ASCII white space characters
        return np.array([self[w] for w in text.split()], dtype=np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """The same as WordHashes().of(text), all at once: quicker where many words are rare, and nothing is remembered."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, text.split())), dtype=">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers so that each bit depends on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of n words; none if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total = mixed(total + hashes[j : j + m] * _MULTIPLIERS[j % 5])
    return total
