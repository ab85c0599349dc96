"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

The vocabulary of such a model has no piece with a space mark after another
character, so merges never cross the start of a word and each distinct word
(its leading space marks included) is encoded once. All new words of a batch
lie in one flat array of symbols. In each round, every word finds its best
ranked pair of neighbours and merges the leftmost one, and with it the word's
other, non-overlapping occurrences of that pair, up to the first merge that
makes a pair of a better rank; the array is then compacted. Rounds end when no
word has a pair left.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rivulet.llm.common import map_batches
from rivulet.llm.pair_table import PairTable

SPACE = "▁"
NO_PAIR = np.int64(1) << 60
#: Words that a Python worker remembers before it forgets half of them, and how long they may be for that.
REMEMBERED, LONG = 150_000, 64


class BpeModel:
    """Pieces, pair ranks and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " \u00e9 e\u0301  \uff21\ufb01\u2460 x\ty "
        if self.library.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are, save for the space marks, are supported")
        size = self.library.vocab_size()
        kinds = [(self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i)) for i in range(size)]
        self.pieces = {self.library.id_to_piece(i): i for i in range(size) if not kinds[i]}
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        # the better of two merges is the one whose piece has the higher score
        ranked = sorted(self.pieces.values(), key=lambda i: (-self.library.get_score(i), i))
        self.rank = np.full(size, NO_PAIR, dtype=np.int64)
        scores = np.array([self.library.get_score(i) for i in ranked])
        self.rank[ranked] = np.searchsorted(-scores, -scores)  # equal scores, equal rank
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece crosses words")
        # every way to cut a piece in two known pieces; symbols are ids, characters without a piece have none
        left, right, whole = [], [], []
        for piece, i in self.pieces.items():
            for cut in range(1, len(piece)):
                a, b = self.pieces.get(piece[:cut]), self.pieces.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        self.merged = PairTable(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(whole, dtype=np.int64))
        # the best rank of any pair that a piece takes part in
        partner = np.full(size, NO_PAIR, dtype=np.int64)
        for side in (left, right):
            np.minimum.at(partner, side, self.rank[whole])
        self.safe = partner > self.rank
        # a character that no longer piece holds never merges, so texts may be cut at line ends
        self.cut_lines = not any("\n" in p for p in self.pieces)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbouring symbols make, or -1."""
        found = np.full(len(a), -1, dtype=np.int64)
        known = np.flatnonzero((a >= 0) & (b >= 0))
        found[known] = self.merged.get(a[known], b[known])
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit numbers, far smaller than a list."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        distinct, inverse = np.unique(points, return_inverse=True)
        # a character without a piece is -1 minus its code point
        symbols = np.array([self.pieces.get(chr(c), -1 - int(c)) for c in distinct], dtype=np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        # what each symbol makes with the next one; after a round only merged symbols and those before them are looked up
        made, changed = np.full(len(symbols), -1, dtype=np.int64), np.arange(len(symbols))
        while len(symbols):
            same = word[1:] == word[:-1]
            made[changed] = -1
            changed = changed[np.append(same, False)[changed]]
            made[changed] = self.pairs(symbols[changed], symbols[changed + 1])
            rank = np.where(made >= 0, self.rank[made], NO_PAIR)
            first = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, first)
            going = best < NO_PAIR
            run = np.diff(np.append(first, len(symbols)))
            if not going.all():  # words without a pair are finished
                stay = np.repeat(going, run)
                done_symbols.append(symbols[~stay])
                done_words.append(word[~stay])
                symbols, word, made, rank = symbols[stay], word[stay], made[stay], rank[stay]
                run, best = run[going], best[going]
                if not len(symbols):
                    break
            least = np.repeat(best, run)
            start = np.concatenate([[0], np.cumsum(run)[:-1]])
            hits = np.flatnonzero(rank == least)
            group = np.repeat(np.arange(len(run)), run)[hits]
            leading = np.append(True, group[1:] != group[:-1])
            # equal ranks could be different pieces; only the leftmost one's piece counts in this round
            piece = made[hits][leading][np.cumsum(leading) - 1]
            # overlapping pairs: of neighbours in a row every second one, from the left
            joined = np.append(False, (np.diff(hits) == 1) & ~leading[1:])
            row_start = np.maximum.accumulate(np.where(joined, -1, np.arange(len(hits))))
            chosen = ((np.arange(len(hits)) - row_start) % 2 == 0) & (made[hits] == piece)
            chosen |= leading
            take = hits[chosen]
            if not self.safe[made[take]].all():
                take = take[~self._after_a_better(symbols, word, made, take)]
            symbols = symbols.copy()
            symbols[take] = made[take]
            alive = np.ones(len(symbols), dtype=bool)
            alive[take + 1] = False
            marked = np.zeros(len(symbols), dtype=bool)
            marked[take] = True
            symbols, word, made, marked = symbols[alive], word[alive], made[alive], marked[alive]
            marked[:-1] |= marked[1:]
            changed = np.flatnonzero(marked)
        symbols = np.concatenate([*done_symbols, symbols]) if done_symbols else symbols
        word = np.concatenate([*done_words, word]) if done_words else word
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        if (symbols < 0).any():  # characters without a piece become their bytes
            symbols, word = self._as_bytes(symbols, word)
        packed, ends = symbols.astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _after_a_better(self, symbols: np.ndarray, word: np.ndarray, made: np.ndarray, take: np.ndarray) -> np.ndarray:
        """Merges that come, in their word, after one that makes a pair of a better rank.

        Merges happen from the left: the left neighbour may be merged already,
        the right one is not.
        """
        piece, w, last = made[take], word[take], len(symbols) - 1
        left = np.where((take > 0) & (word[np.maximum(take - 1, 0)] == w), symbols[np.maximum(take - 1, 0)], -1)
        after_one = np.append(False, (np.diff(take) == 2) & (w[1:] == w[:-1]))
        left = np.where(after_one, piece, left)
        right = np.where((take + 2 <= last) & (word[np.minimum(take + 2, last)] == w), symbols[np.minimum(take + 2, last)], -1)
        better = np.zeros(len(take), dtype=np.int64)
        for a, b in ((left, piece), (piece, right)):
            found = self.pairs(a, b)
            better |= (found >= 0) & (self.rank[found] < self.rank[piece])
        seen = np.cumsum(better) - better
        first = np.append(True, w[1:] != w[:-1])
        return seen > np.maximum.accumulate(np.where(first, seen, 0))

    def _as_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_s, out_w = [], []
        for s, w in zip(symbols.tolist(), word.tolist(), strict=True):
            ids = [s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode()]
            out_s += ids
            out_w += [w] * len(ids)
        return np.array(out_s, dtype=np.int64), np.array(out_w, dtype=np.int64)


_models: dict[str, BpeModel] = {}


def worker_model(path: str) -> BpeModel:
    """This Python worker's model; building it takes a while, and workers outlive tasks."""
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


_encoders: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """This Python worker's encoder; what one task learned serves the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Encodes whole texts; remembers a bounded number of short words."""

    def __init__(self, path: str):
        self.model, self.seen = worker_model(path), {}

    def forget(self) -> None:
        """Keeps half of a full memory; what was met first is what is met most often."""
        if len(self.seen) > REMEMBERED:
            self.seen = dict(itertools.islice(self.seen.items(), REMEMBERED // 2))

    def words(self, text: str) -> list[str]:
        """The text, space marks put in, cut where no merge can cross."""
        if not text:
            return []
        out: list[str] = []
        marked = SPACE + text.replace(" ", SPACE)
        for k, line in enumerate(marked.split("\n") if self.model.cut_lines else [marked]):
            if k:
                out.append("\n")
            if not line:
                continue
            head, *rest = line.split(SPACE)
            if "" in rest:  # several marks in a row, or one at the end, stay together
                out += re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
            else:
                if head:
                    out.append(head)
                out += [SPACE + w for w in rest]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as 32-bit numbers."""
        self.forget()
        split = [self.words(t) for t in texts]
        words = list(itertools.chain.from_iterable(split))
        found = list(map(self.seen.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new, learned = list({words[k] for k in missing}), {}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            learned.update(zip(part, self.model.encode_words(part), strict=True))
        for k in missing:
            found[k] = learned[words[k]]
        self.seen.update((w, ids) for w, ids in learned.items() if len(w) <= LONG)
        out, at = [], 0
        for part in split:
            out.append(np.frombuffer(b"".join(found[at : at + len(part)]), dtype=np.int32))
            at += len(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.library.decode(ids)


def encode(docs: DataFrame, model: str, ids: str = "ids", decoded: str | None = None, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with its ids, and the decoded text if named.

    ``model`` is the path of a BPE model file with byte pieces that every executor has.
    No begin or end ids are added. A null text counts as empty and gives no
    ids. Very long texts are encoded whole; words longer than LONG are not remembered.
    Equal ranks are settled from the left. Other columns stay, save those with the names of new ones;
    repeated rows are encoded alike; an empty table gives an empty result.
    """
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    rows = docs.select(*[f"`{c}`" for c in keep])
    out = [c for c in keep if not (drop_text and c == text)]
    schema = T.StructType([*[rows.schema[c] for c in out], *new])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or worker_encoder(model)
            found = encoder.arrays([t or "" for t in batch.column(keep.index(text)).to_pylist()])
            ends = pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32()))]
            if decoded:
                columns.append(pa.array([encoder.decode(x.tolist()) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(keep.index(c)) for c in out], *columns], names=[f.name for f in schema])

    return map_batches(rows, encoded, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; null ids count as none."""
    keep = [c for c in rows.columns if c != decoded]
    rows = rows.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            found = [library.decode(x or []) for x in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*keep, decoded])

    return map_batches(rows, texts, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
