"""Hard negatives, exact top-k and the prefix trie against plain Python, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm.exact_topk import top_k
from rivulet.llm.hard_negatives import Pivots, brackets, hard_negatives
from rivulet.llm.prefix_trie import prefix_trie
from rivulet.llm.vector_blocks import divisible, product

VECTORS = "vec_id long, label int, embedding array<float>, score double, rank string, vector int"


def odd_vectors(n=260, seed=5):
    """Clusters, copies, ties, nulls, non-finite and empty vectors, other lengths, repeated rows and ids."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(12)] for _ in range(5)]
    rows = [(i, r.choice([0, 1, 2, None]) if i % 17 == 0 else i % 4, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, i % 3, [0.25] * 12) for i in range(40)]  # ties
    rows += [(50, 1, [0.5] * 12), (50, 1, [0.5] * 12), (7, 1, [1.0] * 12)]  # ids of several vectors, repeated rows
    rows += [(2000, 1, None), (2050, 1, [math.nan] * 12), (2100, 1, [math.inf] + [0.0] * 11), (2150, 1, [None] * 12), (None, 1, [0.5] * 12)]
    rows += [(2200, 1, []), (2250, 2, [0.0] * 12), (2300, 1, [0.5] * 3), (2350, 3, [0.01] * 5000), (-50, 0, [-0.3] * 12)]
    return [(*row, 1.0, "x", 3) for row in rows]


def integers(rows):
    found = set()
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        found.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    return sorted(found, key=str)


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k):
    rows = {(i, v) for i, _, v in integers(rows)}
    out = []
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-inner(v, w), i) for i, w in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_top_k(spark, block_rows):
    rows = odd_vectors()
    got = top_k(spark.createDataFrame(rows, VECTORS), divisible(50), 5, lists=3, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5)


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, 1, [0.5, 0.5], 1.0, "", 1), (1, 1, [-0.5, 0.2], 1.0, "", 1), (50, 1, [0.1, 0.1], 1.0, "", 1)]
    vectors = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, top_k(vectors, divisible(50)).collect())) == brute_top(rows, 5)
    assert top_k(vectors.limit(0), divisible(50)).count() == 0
    assert top_k(vectors.where("vec_id = 1"), divisible(50)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        top_k(vectors, divisible(50), 0)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, 1, [60_000.0 + i / 256, 59_999.0 - i / 256, float(i)] * 30, 1.0, "", 1) for i in range(60)]
    got = top_k(spark.createDataFrame(rows, VECTORS), divisible(50)).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5)
    assert max(r["score"] for r in got) > 2**53


def brute_negatives(rows, positives=5, negatives=3):
    rows = [r for r in integers(rows) if r[1] is not None]
    out = []
    for anchor, label, v in rows:
        if anchor % 50:
            continue
        scored = sorted((-inner(v, w), i, other) for i, other, w in rows if i != anchor)
        for p, positive, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(-n, i) for n, i, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(anchor, positive, k + 1, i, -p, n) for k, (n, i) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_hard_negatives(spark, block_rows):
    rows = odd_vectors(seed=6)
    got = hard_negatives(spark.createDataFrame(rows, VECTORS), divisible(50), block_rows=block_rows).collect()
    want = brute_negatives(rows)
    assert len(want) > 20
    assert sorted(map(tuple, got)) == want


def test_hard_negatives_of_one_label_and_no_rows(spark):
    vectors = spark.createDataFrame([(i, 1, [0.1 * i, 0.2], 1.0, "", 1) for i in range(60)], VECTORS)
    assert hard_negatives(vectors, divisible(50)).count() == 0
    assert hard_negatives(vectors.limit(0), divisible(50)).count() == 0


def test_brackets_hold_scores():
    r = np.random.default_rng(3)
    rows = r.integers(-200, 200, (400, 16)).astype(np.int32)
    rows[:40] = rows[0]
    anchors = rows[::25]
    pivots = Pivots(rows[:100], int((rows.astype(np.int64) ** 2).sum(axis=1).max()))
    table, (distances, both) = pivots.table(rows), pivots.anchors(anchors)
    for anchor, at, sum_ in zip(anchors, distances, both, strict=True):
        low, high = brackets(at, sum_, table)
        score = product(anchor[None], rows)[0]
        assert (low <= score).all()
        assert (score <= high).all()


# conversations


def brute_trie(rows, group=20):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, group)), [])[:h] + convs[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    saved = {n: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n, m in members.items()}
    inner_nodes = {n[:-1] for n in members if n}
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))
        children = sum(len(x) == len(n) + 1 for x in below)
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children, sum(x not in inner_nodes for x in below), sum(saved[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations():
    r = random.Random(2)
    rows = []
    for c in [*range(-25, 90), 10**15]:
        for turn in range(r.randint(1, 6)):
            rows.append((c, None if r.random() < 0.05 else turn, r.choice(["user", "assistant", None]), r.choice(["", None, "a b", "hello  there\n", " ".join(["w"] * 2000)])))
    rows += [(60, 3, "user", "same"), (60, 3, "user", "same"), (61, 2, "ab", "c"), (61, 2, "a", "bc"), (None, 1, "user", "lost"), (100, 1, "user", "x"), (None, None, None, None)]
    rows += [(200, i, "user", f"t {i}") for i in range(60)]
    return [(*x, 5, "mine") for x in rows]


@pytest.mark.parametrize("chunk", [4, 4096])
def test_prefix_trie(spark, chunk):
    rows = odd_conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, node string")
    got = sorted(map(tuple, prefix_trie(turns.repartition(5), chunk=chunk).collect()), key=str)
    assert got == brute_trie(rows)


def test_prefix_trie_of_copies_in_several_ranges(spark):
    """Hundreds of equal conversations, one conversation of most of the rows, and repeated turns; ids meet in several texts."""
    rows = [(c, 0, "user", "hi") for c in range(700)] + [(5, None, "user", "again")] * 300
    turns = spark.createDataFrame([(*x, 1, "") for x in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(7)
    got = sorted(map(tuple, prefix_trie(turns, chunk=100).collect()), key=str)
    assert got == brute_trie(rows)


def test_no_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(turns).count() == 0
    alone = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie(alone).select(F.count("*")).first()[0] == 0
