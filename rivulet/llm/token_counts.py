"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text is cut into pre-tokens; the number of tokens of a pre-token is that of
its best segmentation into pieces of the vocabulary. The new, distinct pre-tokens of
a batch lie in one trie, and the forward score of a trie node (best log
probability of the characters from the root, and the number of pieces used) is
computed once, however many pre-tokens share the prefix; all nodes of a depth are
computed at once. A pre-token's count is that of its last node, and is remembered.

The vocabulary is that of a public tokenizer; the probabilities of its pieces are
estimated from the whole corpus: its distinct pre-tokens are counted, and in each round
their best segmentations under the model so far give the next one's frequencies.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import map_batches, materialise
from rivulet.llm.pair_table import PairTable
from rivulet.llm.words import texts_of

SPACE = "▁"
#: Pre-tokens are laid out in rows of one of these widths, which bounds their memory; those longer than LONG are scored one by one.
WIDTHS = (12, 24, 64, LONG := 200)
#: Characters laid out at once, pre-tokens that a Python worker remembers, and that an estimate takes at once.
CELLS, REMEMBERED, AT_ONCE = 1 << 19, 300_000, 32_768


class UnigramModel:
    """Pieces with log probabilities; a character outside all pieces costs its bytes."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def from_sentencepiece(cls, path: str) -> UnigramModel:
        """The pieces of a model file, a piece's probability falling with its rank as 1 / (rank + 100).

        What an estimate starts from; the file lends its vocabulary and order only.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        usable.sort(key=lambda i: (-sp.get_score(i), i))
        total = sum(1.0 / (r + 100) for r in range(len(usable)))
        return cls({sp.id_to_piece(i): -math.log((r + 100) * total) for r, i in enumerate(usable)}, -math.log((len(usable) + 100) * total) - 1.0)

    def step(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int, int]:
        """Best score for word[:end], its fewest pieces, and the length of the last one (0: bytes), from those of all shorter prefixes."""
        best, pieces, last = -math.inf, 0, 0
        known = self.pieces
        for start in range(max(0, end - self.longest), end):
            p = known.get(word[start:end])
            if p is not None:
                s = scores[start] + p
                if s > best or (s == best and counts[start] + 1 < pieces):
                    best, pieces, last = s, counts[start] + 1, end - start
        if word[end - 1] not in known:
            size = len(word[end - 1].encode())
            s = scores[end - 1] + size * self.byte_score
            if s > best or (s == best and counts[end - 1] + size < pieces):
                best, pieces, last = s, counts[end - 1] + size, 0
        return best, pieces, last

    def reestimated(self, uses: dict[str, int], n_bytes: int) -> UnigramModel:
        """The model of these frequencies, each piece and byte seen half a time more."""
        total = sum(uses.values()) + n_bytes + 0.5 * (len(self.pieces) + 256)
        return UnigramModel({p: math.log((uses.get(p, 0) + 0.5) / total) for p in self.pieces}, math.log((n_bytes / 256 + 0.5) / total))


class PieceTrie:
    """The pieces of a model as one trie; pieces that end at a character are found in one step from those a character before."""

    def __init__(self, model: UnigramModel):
        characters = sorted({c for p in model.pieces for c in p})
        self.points = np.array([ord(c) for c in characters], dtype=np.int64)
        code, states = {c: k for k, c in enumerate(characters)}, {}
        at, over, to = [], [], []
        #: pieces by number, and for each state its piece's number or -1
        self.pieces = list(model.pieces)
        ends = {}
        for k, piece in enumerate(self.pieces):
            state = 0
            for c in piece:
                step = (state, code[c])
                if step not in states:
                    states[step] = len(states) + 1
                    at.append(state), over.append(step[1]), to.append(states[step])
                state = states[step]
            ends[state] = k
        self.steps = PairTable(np.array(at, dtype=np.int64), np.array(over, dtype=np.int64), np.array(to, dtype=np.int64))
        self.piece = np.full(len(states) + 1, -1, dtype=np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.piece[0] = -1  # an empty piece would never end
        self.score = np.array([model.pieces[p] for p in self.pieces], dtype=np.float64)
        self.alone = np.isin(self.points, [ord(p) for p in self.pieces if len(p) == 1])
        self.longest, self.byte_score = model.longest, model.byte_score

    def codes(self, points: np.ndarray) -> np.ndarray:
        """The number of each character, or one that no piece has."""
        if not len(self.points):
            return np.zeros(len(points), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at, len(self.points))


class TrieLevels:
    """Forward scores of all prefixes of some distinct pre-tokens, each prefix once.

    ``words``, space marks included, must be sorted by code points, so that those that share a
    prefix stand together. The trie grows a character at a time, all its nodes of
    that depth at once. ``node[i, k]`` is the node of the first k characters of word i.
    """

    def __init__(self, trie: PieceTrie, words: list[str]):
        self.lengths = lengths = np.array([len(w) for w in words])
        n, m = len(words), int(lengths.max())
        self.points = points = np.full((n, m), -1, dtype=np.int32)
        inside = np.arange(m) < lengths[:, None]
        points[inside] = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<i4")
        new = inside.copy()  # words that are the first of a prefix
        new[1:] &= np.logical_or.accumulate(points[1:] != points[:-1], axis=1)
        self.node = node = np.zeros((n, m + 1), dtype=np.int64)
        size = int(new.sum()) + 1
        self.scores, self.counts = np.zeros(size), np.zeros(size, dtype=np.int64)
        #: length (0: bytes) and number of the last piece of each node
        self.last, self.piece = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.computed = size - 1
        states, at = np.zeros((1, 1), dtype=np.int64), 1  # of each node, by the characters since the state's start
        below = 0
        for end in range(1, m + 1):
            rows = np.flatnonzero(new[:, end - 1])
            node[:, end] = at - 1 + np.cumsum(new[:, end - 1])
            c = points[rows, end - 1]
            code, parent = trie.codes(c), node[rows, end - 1]
            before = states[parent - below]
            r, since = np.nonzero(before >= 0)
            to = trie.steps.get(before[r, since], code[r])
            go = to >= 0
            r, since, to = r[go], since[go], to[go]
            states = np.full((len(rows), min(before.shape[1] + 1, trie.longest)), -1, dtype=np.int64)
            states[:, 0] = 0
            wide = since + 1 < states.shape[1]
            states[r[wide], since[wide] + 1] = to[wide]
            below = at
            here = slice(at, at + len(rows))
            self._best(trie, here, rows, end, r, since, trie.piece[to])
            # a character that is no piece can always be its bytes
            lone = np.flatnonzero(~np.append(trie.alone, False)[code])
            if len(lone):
                width = 1 + (c[lone] >= 0x80) + (c[lone] >= 0x800) + (c[lone] >= 0x10000)
                s, k = self.scores[parent[lone]] + width * trie.byte_score, self.counts[parent[lone]] + width
                to_node = at + lone
                better = (s > self.scores[to_node]) | ((s == self.scores[to_node]) & (k < self.counts[to_node]))
                to_node = to_node[better]
                self.scores[to_node], self.counts[to_node], self.last[to_node], self.piece[to_node] = s[better], k[better], 0, -1
            at += len(rows)

    def _best(self, trie: PieceTrie, here: slice, rows: np.ndarray, end: int, r: np.ndarray, since: np.ndarray, piece: np.ndarray) -> None:
        """The best last piece of each node: highest score, then fewest pieces, then the longest."""
        self.scores[here] = -np.inf
        ends = piece >= 0
        r, length, piece = r[ends], since[ends] + 1, piece[ends]
        if not len(r):
            return
        start = self.node[rows[r], end - length]
        s, k = self.scores[start] + trie.score[piece], self.counts[start] + 1
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        run = np.diff(np.append(first, len(r)))
        best = np.maximum.reduceat(s, first)
        k_best = np.where(s == np.repeat(best, run), k, np.iinfo(np.int64).max)
        fewest = np.minimum.reduceat(k_best, first)
        chosen = np.where(k_best == np.repeat(fewest, run), length, -1)
        longest = np.maximum.reduceat(chosen, first)
        won = chosen == np.repeat(longest, run)  # one for each node
        at = here.start + r[first]
        self.scores[at], self.counts[at], self.last[at], self.piece[at] = best, fewest, longest, piece[won]

    def tokens(self) -> np.ndarray:
        """Tokens of each word."""
        return self.counts[self.node[np.arange(len(self.lengths)), self.lengths]]

    def uses(self, n: np.ndarray, pieces: int) -> tuple[np.ndarray, int]:
        """How often each piece, and bytes outside of pieces, occur in the best segmentations of ``n`` of each word."""
        total, n_bytes = np.zeros(pieces, dtype=np.int64), 0
        row, end = np.arange(len(self.lengths)), self.lengths.copy()
        while len(row):
            node = self.node[row, end]
            last, piece = self.last[node], self.piece[node]
            whole = last > 0
            np.add.at(total, piece[whole], n[row[whole]])
            c = self.points[row[~whole], end[~whole] - 1]
            n_bytes += int(((1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)) * n[row[~whole]]).sum())
            end = end - np.maximum(last, 1)
            going = end > 0
            row, end = row[going], end[going]
        return total, n_bytes


class TrieCounter(dict):
    """Number of tokens of a pre-token, given as bytes without its space mark; remembers a bounded number of short ones."""

    def __init__(self, model: UnigramModel):
        super().__init__()
        self.model, self.trie = model, PieceTrie(model)
        self.computed = 0

    def levels(self, words: list[bytes]) -> Iterator[tuple[list[int], TrieLevels]]:
        """Tries over distinct pre-tokens of at most LONG characters, and which of them they hold."""
        order = sorted(range(len(words)), key=words.__getitem__)  # bytes of UTF-8 sort like code points
        texts = [SPACE + words[i].decode() for i in order]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        for low, high in zip((0, *WIDTHS[:-1]), WIDTHS, strict=True):
            part = np.flatnonzero((lengths > low) & (lengths <= high)).tolist()
            for at in range(0, len(part), CELLS // high):
                chosen = part[at : at + CELLS // high]
                found = TrieLevels(self.trie, [texts[k] for k in chosen])
                self.computed += found.computed
                yield [order[k] for k in chosen], found

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Remembers the tokens of new, distinct pre-tokens; gives back those of pre-tokens that are too long for that."""
        for chosen, found in self.levels(words):
            self.update(zip([words[i] for i in chosen], found.tokens().tolist(), strict=True))
        return {w: self._insert(SPACE + w.decode()) for w in words if len(w) >= LONG and w not in self}

    def _insert(self, word: str, lasts: list[int] | None = None) -> int:
        """Tokens of a single pre-token; ``lasts`` gets the length of the last piece at each of its characters."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            s, n, last = self.model.step(word, end, scores, counts)
            scores.append(s)
            counts.append(n)
            if lasts is not None:
                lasts.append(last)
        return counts[-1]

    def segments(self, raw: bytes) -> tuple[list[str], int]:
        """The pieces of a pre-token's best segmentation, and the number of its bytes outside of pieces."""
        word, lasts, out, n_bytes = SPACE + raw.decode(), [], [], 0
        self._insert(word, lasts)
        end = len(word)
        while end:
            last = lasts[end - 1]
            if last:
                out.append(word[end - last : end])
            else:
                n_bytes += len(word[end - 1].encode())
            end -= last or 1
        return out, n_bytes

    def uses(self, words: list[bytes], n: list[int]) -> Counter:
        """How often each piece ("": bytes outside of pieces) occurs in ``n`` of each of distinct pre-tokens."""
        out, left = Counter(), set(range(len(words)))
        total, times = np.zeros(len(self.trie.pieces), dtype=np.int64), np.array(n, dtype=np.int64)
        for chosen, found in self.levels(words):
            used, n_bytes = found.uses(times[chosen], len(total))
            total += used
            out[""] += n_bytes
            left.difference_update(chosen)
        for i in left:
            pieces, n_bytes = self.segments(words[i])
            for p in pieces:
                out[p] += n[i]
            out[""] += n_bytes * n[i]
        for k in np.flatnonzero(total).tolist():
            out[self.trie.pieces[k]] += int(total[k])
        return out

    def totals(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of whole texts; what is new in them is learned at once."""
        if len(self) > REMEMBERED:  # what was met first is what is met most often
            kept = list(itertools.islice(self.items(), REMEMBERED // 2))
            self.clear()
            self.update(kept)
        split = [t.split() for t in texts]
        long = self.learn([w for w in set(itertools.chain.from_iterable(split)) if w not in self])
        if long:
            return [(len(words), sum(self[w] if w in self else long[w] for w in words)) for words in split]
        return [(len(words), sum(map(self.__getitem__, words))) for words in split]

    def total(self, text: bytes) -> tuple[int, int]:
        """Pre-tokens and tokens of a whole text."""
        return self.totals([text])[0]


_counters: list[tuple[UnigramModel, TrieCounter]] = []


def worker_counter(model: UnigramModel) -> TrieCounter:
    """This Python worker's counter of the model used last. Workers outlive tasks, and what one task learned serves the next."""
    if not _counters or _counters[0][0] is not model:
        _counters[:] = [(model, TrieCounter(model))]
    return _counters[0][1]


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the distinct pre-tokens of all texts, as bytes, and how often they occur."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                found.update((t or b"").split())
            if len(found) > 100_000:
                yield _words(found)
                found.clear()
        yield _words(found)

    return map_batches(docs.select(F.col(f"`{text}`").cast("string")), counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _words(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def estimate(docs: DataFrame, start: UnigramModel, rounds: int = 2, text: str = "text") -> UnigramModel:
    """A model of the pieces of ``start`` with frequencies from all of ``docs``.

    Rounds of hard expectation maximisation over the distinct pre-tokens, which
    grow with the corpus; only one number for each piece of the vocabulary comes to the driver.
    Null and empty texts add nothing; with no texts all pieces are alike.
    """
    words, model = materialise(pretoken_counts(docs, text), "pretokens"), start
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def used(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trie, uses, words, times = worker_counter(sent.value), Counter(), [], []
            for batch in batches:
                words += batch.column(0).to_pylist()
                times += batch.column(1).to_pylist()
                if len(words) >= AT_ONCE:
                    uses.update(trie.uses(words, times))
                    words, times = [], []
            uses.update(trie.uses(words, times))
            yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.int64())], names=["piece", "n"])

        rows = map_batches(words, used, "piece string, n long", 4096).groupBy("piece").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
        uses = {r["piece"]: r["n"] for r in rows}
        n_bytes = uses.pop("", 0)
        model = model.reestimated(uses, n_bytes)
    return model


def count_tokens(docs: DataFrame, model: UnigramModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``n_pretokens`` and ``n_tokens``.

    Pre-tokens are the runs of other than ASCII white space, each with a space
    mark in front. Null and empty texts have none; very long texts and pre-tokens
    are counted whole. A segmentation of the
    highest score counts, of those with equal scores the one with the fewest
    pieces. Other columns stay, save those with the names of new ones; repeated
    rows count alike; an empty table gives an empty result.
    """
    new = ("n_pretokens", "n_tokens")
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(*[f"`{c}`" for c in keep])
    out = [c for c in keep if keep_text or c != text]
    schema = T.StructType([*[rows.schema[c] for c in out], *[T.StructField(c, T.LongType()) for c in new]])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_counter(sent.value)
        for batch in batches:
            found = np.array(trie.totals(texts_of(batch.column(keep.index(text)))), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(keep.index(c)) for c in out], pa.array(found[:, 0]), pa.array(found[:, 1])], names=schema.names)

    return map_batches(rows, counted, schema)
