"""Each stage of the pipeline against plain Python, on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from rivulet.llm import classifier, mixing
from rivulet.llm.common import materialise
from rivulet.llm.words import WordHashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(900_000).cast("bigint")))
    docs = docs.unionByName(docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 910_000, "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    out = [materialise(docs, "in")]
    for _, f in p.STAGES:
        out.append(materialise(f(spark, out[-1], SF), "stage"))
    return [(x.columns, x.collect()) for x in out]


def test_names_and_columns(stages):
    assert [n for n, _ in p.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "mixing sources", "SentencePiece encoding"]
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])
    counts = [len(rows) for _, rows in stages]
    assert counts[0] >= counts[1] >= counts[2] > counts[3]


def test_classifier_stage_like_plain_python(spark):
    """Rows to learn from and scores, one at a time; the fit itself is tested with the operator."""
    larger = "/root/testdata/sf0.01"  # among the fewer documents of the smallest tables none is rejected
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    before = docs.collect()
    learned = [(r["doc_id"], r["text"], labels[r["doc_id"]]) for r in before if labels.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    assert 0 < len(learned) < len(before)
    weights = classifier.fit(spark.createDataFrame(learned, "doc_id long, text string, label int"))
    words, shapes = WordHashes(), classifier.WordShapes()

    def score(text):
        at, x = classifier.features((text or "").encode(), words, shapes)
        return 1 / (1 + math.exp(-sum(float(weights[k]) * v for k, v in zip(at, x, strict=True))))

    want = Counter((r["doc_id"], r["text"]) for r in before if score(r["text"]) >= 0.3)
    got = Counter((r["doc_id"], r["text"]) for r in p.classified(spark, docs, larger).collect())
    assert got == want and 0 < want.total() < len(before)


def test_rules_stage(stages):
    kept = {r["doc_id"] for r in stages[2][1]}
    for r in stages[1][1]:
        words = (r["text"] or "").encode().split()
        if len(words) < 10:
            assert r["doc_id"] not in kept
    assert None not in {r["text"] for r in stages[2][1]}


def test_one_of_each_class_stays(stages):
    before, after = stages[2][1], stages[3][1]
    ids = [r["doc_id"] for r in after]
    assert len(set(ids)) == len(ids)
    texts = Counter(r["text"] for r in after)
    assert max(texts.values()) == 1 and 900_000 not in ids
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [r["text"].split()] for i in range(len(w) - 4)} for r in before}
    for r in before:  # what went is near to something
        if r["doc_id"] not in ids:
            a = sets[r["doc_id"]]
            assert max(len(a & b) / len(a | b) for i, b in sets.items() if i != r["doc_id"]) > 0.7


def test_mixture_stage(stages):
    size = lambda r: len(r["text"].encode().split())
    before, after = {r["doc_id"]: r for r in stages[3][1]}, Counter(r["doc_id"] for r in stages[4][1])
    assert set(after) <= set(before) and max(after.values()) <= 2
    total, taken = sum(map(size, before.values())), sum(size(r) for r in stages[4][1])
    assert 1.5 * total - 2 * max(map(size, before.values())) <= taken <= 1.5 * total


def plain_mixture(rows):
    """How often each (doc_id, text) is taken: queues in the order of hashes, merged by finish times up to the budget."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    queues: dict = {}
    for r in rows:
        place = digest(f"42:{'null' if r['doc_id'] is None else r['doc_id']}:{digest(r['text'] or '')}")
        queue = queues.setdefault(r["source"], Counter())
        queue[place] += len((r["text"] or "").encode().split())
    sources = sorted(queues, key=lambda s: (s is None, s or ""))
    size = {s: sum(queues[s].values()) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, full = sum(size.values()), set()
    while True:  # those that reach twice their size leave the rest to the others
        level = (3 * total - 2 * sum(2 * size[s] for s in full)) / (2 * sum(weight[s] for s in sources if s not in full))
        over = {s for s in sources if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in sources}
    entries = []
    for i, s in enumerate(sources):
        served = 0
        for turn in (0, 1):
            for place in sorted(queues[s]):
                served += queues[s][place]
                if queues[s][place]:
                    entries.append((served / target[s], i, turn, place, queues[s][place]))
    taken, used = Counter(), 0
    for _, i, _, place, n in sorted(entries):
        used += n
        if used > 1.5 * total:
            break
        taken[sources[i], place] += 1
    out = Counter()
    for r in rows:
        place = digest(f"42:{'null' if r['doc_id'] is None else r['doc_id']}:{digest(r['text'] or '')}")
        out[r["doc_id"], r["text"]] += taken[r["source"], place] if r["text"] and r["text"].encode().split() else 0
    return +out


def test_mixture_stage_like_plain_python(spark, stages):
    assert Counter((r["doc_id"], r["text"]) for r in stages[4][1]) == plain_mixture(stages[3][1])
    docs = materialise(spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source"))), "with-null-sources")
    got = Counter((r["doc_id"], r["text"]) for r in p.mixed(spark, docs, SF).collect())
    assert got == plain_mixture(docs.collect())


def test_mixture_stage_of_a_billion_words(spark, stages, monkeypatch):
    """Texts that count a great many times give the same mixture; their total fits an int, the budget does not."""
    before, docs = stages[3][1], spark.createDataFrame(stages[3][1], "doc_id long, text string, lang string, source string, n_chars long")
    times = 10**9 // sum(len((r["text"] or "").encode().split()) for r in before)
    count = mixing.word_count
    monkeypatch.setattr(mixing, "word_count", lambda text="text": f"{count(text)} * {times}L")
    got = Counter((r["doc_id"], r["text"]) for r in p.mixed(spark, docs, SF).collect())
    assert got == plain_mixture(before)


def test_repeated_rows_with_columns_that_have_no_order(spark):
    text = "one text of a good many words that is there three times over"
    rows = [(1, text, "s", {"b": 2}), (1, text, "s", {"a": 1}), (2, text, "s", None), (3, "another text of quite a few words about the sea", "s", {"c": 3})]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>"), "maps")
    got = p.deduplicated(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["tags"]) for r in got.collect()) == [(1, text, {"a": 1}), (3, rows[3][1], {"c": 3})]


def test_encoding_stage(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in stages[4][1]}
    assert len(stages[5][1]) == len(stages[4][1])
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in stages[5][1])


CLASHING = ["score", "kept", "size", "copies", "target", "taken", "failed_rule", "source_size", "finish", "_h", "_n", "_of", "_words", "_slot", "class_id", "n", "col", "_row", "id", "rep"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated doc_ids, null and very long texts, and columns that operators name themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    some = docs.limit(3)
    docs = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(some.withColumn("text", F.lit(None).cast("string")))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(800_000).cast("bigint"), "text": F.expr("concat_ws(' ', transform(sequence(1, 20000), i -> concat('word', i)))")}))
    return materialise(docs.select("*", *[F.lit(f"my {c}").alias(c) for c in CLASHING]), "odd")


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows_and_clashing_columns(spark, odd, k):
    name, stage = p.STAGES[k]
    got = stage(spark, odd, SF)
    if k == 4:
        assert got.count() == odd.count()
        return
    assert got.columns == odd.columns
    rows = got.collect()
    assert rows and all(r[c] == f"my {c}" for r in rows for c in CLASHING), name
    whole = Counter((r["doc_id"], r["text"], r["source"]) for r in odd.collect())
    assert {(r["doc_id"], r["text"], r["source"]) for r in rows} <= set(whole)
    if k == 2:
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and 800_000 in ids and sum(r["doc_id"] is None for r in rows) == 3


@pytest.mark.parametrize("k", range(5))
def test_stages_with_an_empty_table(spark, k):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    got = p.STAGES[k][1](spark, empty, SF)
    assert got.count() == 0 and (k == 4 or got.columns == empty.columns)
