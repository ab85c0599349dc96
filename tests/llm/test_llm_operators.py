"""Each operator against plain Python on small tables with every odd case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat, classifier, embedding_dedup, minhash, mixing, quality_rules, query_quality, sentencepiece_bpe, token_counts, token_output, url_filter
from rivulet.llm.common import only_ids, scratch_path, without_ids
from rivulet.llm.components import components
from rivulet.llm.hnsw import Hnsw
from rivulet.llm.tokenfile import Reader, Writer

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


# 1


def test_urls(spark):
    urls = [
        ("http://A.Example.org/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://sub.shop.com/de/1", "sub.shop.com", "/de/1", "com/de/", "block"),
        ("ftp://shop.com/fr/", "shop.com", "/fr/", "com/fr/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://x.org/", "x.org", "/", "org/", "allow"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("x://a://b/c", "a:", "//b/c", None, "allow"),
        ("no scheme.org/x", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://É.NET?q", "É.net", "", None, "allow"),
        ("http://long.net/" + "a/" * 5000, "long.net", "/" + "a/" * 5000, None, "allow"),
    ]
    rows = [(i, u[0], 1, "mine") for i, u in enumerate([*urls, *urls[:2]])]
    rows += [(100 + i, f"http://bad.net/spam/{i}", 1, "mine") for i in range(30)] + [(200 + i, f"http://bad.net/ham/{i}", 1, "mine") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n long, verdict string")
    labels = pages.where("page_id >= 100").select("url", (F.col("page_id") < 200).alias("bad"))
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels.unionByName(labels.limit(3))).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), urls[i][0][:50] if urls[i][0] else None
    assert {got[i]["verdict"] for i in range(100, 130)} == {"block"}
    assert {got[i]["verdict"] for i in range(200, 230)} == {"allow"}
    assert got[100]["template"] == "/spam/<n>"
    assert url_filter.filter_urls(pages.limit(0), labels.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages.where("page_id >= 100"), labels.limit(0)).collect()} == {"allow"}


def test_many_slugs_become_a_wildcard(spark):
    pages = spark.createDataFrame([(i, f"http://blog.net/post/{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(300)], "page_id long, url string")
    templates = {r["template"] for r in url_filter.filter_urls(pages, pages.selectExpr("url", "false AS bad").limit(0)).collect()}
    assert templates == {"/*/*"}


def _verdicts(spark, urls):
    """Verdicts by url of (url, bad or None)."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(u, b) for u, b in urls if b is not None], "url string, bad boolean")
    return {r["url"]: r["verdict"] for r in url_filter.filter_urls(pages, labels).collect()}


def test_labels_far_down_a_path_tell_pages_apart(spark):
    way = "http://deep.net/" + "/".join("abcdefghijklmnop")
    urls = [(f"{way}/{kind}/x{i}", kind == "bad") for kind in ("bad", "good") for i in range(50)]
    assert all(v == ("block" if "/bad/" in u else "allow") for u, v in _verdicts(spark, urls).items())


def test_a_rare_bad_branch_of_a_wide_node_stays(spark):
    urls = [(f"http://wide.net/spam/{i}", True) for i in range(4)] + [(f"http://wide.net/{chr(97 + i % 26)}{i}/p", False) for i in range(60)]
    assert all(v == ("block" if "/spam/" in u else "allow") for u, v in _verdicts(spark, urls).items())


def test_numbers_with_unlike_labels_are_no_wildcard(spark):
    urls = [(f"http://years.net/{year}/p{i}", year == 2019) for year in (2019, 2020) for i in range(40)] + [("http://years.net/2021/x", None), ("http://years.net/*/y", None)]
    got = _verdicts(spark, urls)
    assert all(v == ("block" if "/2019/" in u else "allow") for u, v in got.items() if "/2021/" not in u and "*" not in u)


# 2


def test_token_counts(documents, no_documents, texts):
    model = token_counts.UnigramModel.from_sentencepiece(PIECES)

    def brute(word):
        word = "▁" + word
        best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if (p := model.pieces.get(word[start:end])) is not None:
                    best[end] = max(best[end], (best[start][0] + p, best[start][1] - 1))
            if word[end - 1] not in model.pieces:
                size = len(word[end - 1].encode())
                best[end] = max(best[end], (best[end - 1][0] + size * model.byte_score, best[end - 1][1] - size))
        return -best[-1][1]

    known = {}
    got = token_counts.count_tokens(documents, model).collect()
    assert len(got) == documents.count()
    for r in got:
        words = [w for w in words_of(r["text"])]
        if len(words) > 1000 or any(len(w) > 500 for w in words):
            continue
        assert r["n_pretokens"] == len(words)
        assert r["n_tokens"] == sum(known.setdefault(w, brute(w)) for w in words)
    trie = token_counts.TrieCounter(model)
    trie.total(b"abcdef abcdeg abcdef")
    assert trie.computed == len("▁abcdef") + 1  # the shared prefix once
    assert trie.total(("x" * 400).encode())[1] == trie._insert("▁" + "x" * 400)
    assert token_counts.count_tokens(no_documents, model).count() == 0


# 3


def test_embeddings(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 16))
    rows = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + r.normal(size=16) * 0.1).astype(np.float32).tolist(), i % 2) for i in range(30)]
    rows += [(200 + i, base[0].astype(np.float32).tolist(), 0) for i in range(40)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [None, *[1.0] * 15], 0), (303, [float("nan")] * 16, 0), (304, [float("inf")] * 16, 0), (305, rows[0][1], None), (306, rows[0][1][:8], 0), (307, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("mine"))
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(df, shard_rows=30, block_rows=25).collect()}
    usable = [(i, np.array(v, dtype=float), k) for i, v, k in rows if v and k is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: {j for j, w, m in usable if j != i and m == k and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, k in usable}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["n_links"] == len(near.get(i, ())), i
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_one_vec_id_of_unlike_vectors(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.05], 1), (3, [0.02, 1.0], 1), (9, [-1.0, 0.0], 1)]
    audit = []
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), audit=audit)
    # each row has its own vector's links; the id joins its rows' components
    assert sorted(map(tuple, got.collect())) == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (7, 1, 3, False), (9, 0, 9, True)]
    alone = embedding_dedup.near_duplicates(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int"))
    assert sorted(r["n_links"] for r in alone.where("vec_id = 5").collect()) == [0, 1]
    assert len(audit) == 1 and 0 < audit[0][0] <= audit[0][1]


def test_graph_recall():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, found = Hnsw.loads(Hnsw(x).dumps()).search(x[::30].astype(np.float32), 64)
    truth = np.argsort(-(x[::30] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, found, strict=True)]) >= 0.9


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [tuple(map(int, r.integers(1000, 1400, 2))) for _ in range(250)] + [(5, 5), (7, None)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    for in_one_task in (0, 10**6):
        assert {x["id"]: x["component"] for x in components(links, in_one_task=in_one_task).collect()} == {x: find(x) for x in parent}


# 4


def test_targets_and_mixture(spark, documents, no_documents):
    got = mixing.mix_sources(documents).collect()
    assert len(got) == documents.count()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(words_of(r["text"])) and 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target = 1.5 * sum(sizes.values()), {}
    open_ = dict(weight)
    while open_:  # share out, stop those above twice their size, share out what is over
        left = budget - sum(target.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
    longest, taken = max(r["size"] for r in got), Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in sizes)
    assert sum(taken.values()) <= budget + 1e-6
    again = mixing.mix_sources(documents.repartition(3)).collect()
    assert sorted((r["kept"] or "", r["taken"]) for r in again) == sorted((r["kept"] or "", r["taken"]) for r in got)
    assert mixing.mix_sources(no_documents).count() == 0
    assert {r["taken"] for r in mixing.mix_sources(documents.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


@pytest.mark.parametrize("least", [10**7, 2**31 // 3 // 40, 2**31 // 40, 10**9])
def test_mixture_of_billions_of_words(spark, least):
    """Totals below and above 2^31, and below it with a budget above."""
    rows = [(i, f"s{i % 3}", least + 1009 * i) for i in range(40)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), size="size", finish=True).collect()
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    total, weight = sum(sizes.values()), {"s0": 5, "s1": 2, "s2": 1}
    left = 3 * total / 2 - 2 * sizes["s0"]  # s0 stops at twice its size, what is over goes to the others
    target = {"s0": 2 * sizes["s0"], "s1": left * 2 / 3, "s2": left / 3}
    assert {r["source"]: r["target"] for r in got} == pytest.approx(target)
    entries = []
    for s in sizes:
        served = 0
        for turn in (0, 1):
            for place, i, n in sorted((hashlib.md5(f"42:{i}:".encode()).hexdigest(), i, n) for i, source, n in rows if source == s):
                served += n
                entries.append((served / target[s], s, turn, i, n))
    copies, used = Counter(), 0
    for _, _, _, i, n in sorted(entries):
        used += n
        if used > 1.5 * total:
            break
        copies[i] += 1
    assert {r["doc_id"]: (r["copies"], r["taken"]) for r in got} == {i: (copies[i], copies[i] * n) for i, _, n in rows}
    finish = {i: f for f, _, turn, i, _ in entries if turn == 0}
    assert {r["doc_id"]: r["finish"] for r in got} == pytest.approx(finish)


# 5


def test_quality_rules(documents, no_documents):
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
    got = quality_rules.quality_rules(documents, features=counts).collect()
    assert len(got) == documents.count()
    for r in got:
        text, words = r["text"] or "", words_of(r["text"])
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(windows)
        repeated = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words_of(x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_lines"] == len(lines)
        assert r["n_repeat_words"] == len(repeated)
        rejected = len(words) < 10 or 100 * len(repeated) > 20 * len(words) or 10 * r["n_symbols"] > 3 * len(words) or 2 * r["n_dup_lines"] > len(lines) or 2 * r["n_upper"] > r["word_chars"] or not 2 * len(words) <= r["word_chars"] <= 25 * len(words)
        assert r["kept"] is not rejected and (r["failed_rule"] is not None) == rejected
    short = quality_rules.quality_rules(documents).where("kept").count()
    assert short == sum(r["kept"] for r in got)
    assert quality_rules.quality_rules(no_documents).count() == 0
    ordered = quality_rules.order_rules(documents)
    assert {r for r, _, _ in ordered} == set(quality_rules.RULES) and all(0 <= s <= 1 and c > 0 for _, c, s in ordered)


# 6


def test_sentencepiece(documents, no_documents):
    library = sentencepiece_bpe.BpeModel(PIECES).library
    encoded = sentencepiece_bpe.encode(documents, PIECES, decoded="decoded")
    got = encoded.collect()
    assert len(got) == documents.count()
    for r in got:
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    assert {(str(r["ids"]), r["decoded"]) for r in sentencepiece_bpe.decode(encoded.drop("decoded"), PIECES).collect()} == {(str(r["ids"]), r["decoded"]) for r in got}
    assert sentencepiece_bpe.encode(no_documents, PIECES).count() == 0


def test_merge_rounds_like_the_library():
    import random

    r = random.Random(5)
    encoder = sentencepiece_bpe.Encoder(PIECES)
    parts = ["a", "b", "ab", " ", "  ", "\n", "▁", "é", "梦", "😀", "\x00", "ing", "00", "==", "--", "<s>", "the "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 80))) for _ in range(600)] + ["a" * 700, "=" * 999, " " * 50, "ab" * 300]
    assert encoder.encode(texts) == [encoder.model.library.encode(t) for t in texts]


# 7


def weighted(text, idf):
    from rivulet.llm.words import WordHashes

    return minhash.weighted_shingles(WordHashes().of((text or "").encode()), idf)


def test_minhash(documents, no_documents):
    rows = documents.collect()
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicate_classes(documents).collect()]
    assert Counter(i for i, _ in got) == Counter(r["doc_id"] for r in rows)
    df, n = minhash.document_frequency(documents)
    assert n == len(rows)
    idf = minhash.idf_table(df, n)
    sets = [(r["doc_id"], weighted(r["text"], idf)) for r in rows if r["doc_id"] is not None]
    near = {i: {i} for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and minhash.weighted_jaccard(a, b) >= 0.8:
                near[i].add(j)
                near[j].add(i)
    for i, c in got:
        if i is None:
            assert c is None
            continue
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert c == min(seen), i
    assert minhash.near_duplicate_classes(no_documents).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    """Copies that each differ from the first in their own place, so that the first one alone is near to all."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(1400):
        words = list(base)
        for j in range(3):
            words[(k * 7 + j * 61) % 200] = f"new{k}x{j}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["class_id"] for r in minhash.near_duplicate_classes(docs).select("class_id").distinct().collect()} == {0}


def test_pairs_in_a_crowd_of_texts_on_one_passage(spark):
    """200 texts on one passage are alike to 0.74, and the two of each pair to 0.82."""
    passage = [f"w{i}" for i in range(200)]
    texts = [" ".join([*passage, *(f"p{k // 2}x{j}" for j in range(8)), *(f"t{k}x{j}" for j in range(12))]) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == {k: k // 2 * 2 for k in range(200)}


def test_pairs_in_a_bucket_of_many_blocks(spark, monkeypatch):
    """In blocks of 16 most pairs are of two blocks; what is found does not depend on it."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    passage = [f"w{i}" for i in range(200)]
    texts = [" ".join([*passage, *(f"p{k // 2}x{j}" for j in range(8)), *(f"t{k}x{j}" for j in range(12))]) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == {k: k // 2 * 2 for k in range(200)}


def test_pairs_of_a_crowd_never_become_rows(spark, monkeypatch):
    """Nearly all 44,850 pairs of these texts are alike to 0.74; no table has more rows than texts times bands."""
    written, materialise = {}, minhash.materialise

    def counted(df, name):
        out = materialise(df, name)
        written[name] = max(out.count(), written.get(name, 0))
        return out

    monkeypatch.setattr(minhash, "materialise", counted)
    monkeypatch.setattr(minhash, "BLOCK", 40)
    passage = [f"w{i}" for i in range(200)]
    texts = [" ".join([*passage, *(f"p{k // 2}x{j}" for j in range(8)), *(f"t{k}x{j}" for j in range(12))]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == {k: k // 2 * 2 for k in range(300)}
    assert max(written.values()) <= 300 * minhash.BANDS, written


def test_samples_agree_like_weighted_jaccard():
    r = np.random.default_rng(0)
    keys = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    sampler = minhash.Sampler(k=800)
    a = (np.sort(keys[:300]), r.uniform(1, 3, 300))
    b = (np.sort(keys[100:]), r.uniform(1, 3, 300))
    share = np.mean(sampler.sample(*a) == sampler.sample(*b))
    assert abs(share - minhash.weighted_jaccard(a, b)) < 0.06


# 8


def test_classifier(spark, documents, no_documents):
    good = [(i, f"the quiet river runs past house number {i} and the old mill by the road", 1) for i in range(120)]
    junk = [(1000 + i, f"BUY!! NOW!! {i} CHEAP!! PILLS!! CLICK!!", 0) for i in range(60)]
    rows = spark.createDataFrame([*good, *junk], "doc_id long, text string, label int")
    weights = classifier.fit(rows.unionByName(spark.createDataFrame([(5000, "none", None)], rows.schema)))
    assert (classifier.fit(rows) == weights).all()
    got = classifier.score(rows, weights).collect()
    assert all((r["score"] >= 0.3) == (r["label"] == 1) for r in got)
    odd = classifier.score(documents, weights).collect()
    assert len(odd) == documents.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if not words_of(r["text"])}) == 1
    assert classifier.score(no_documents, weights).count() == 0
    assert not classifier.fit(rows.limit(0)).any()
    held = rows.select("doc_id", classifier.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def test_held_out_accuracy(spark):
    p = query_quality.op8_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert p[p.quality == 1].score.median() > p[p.quality == 0].score.max() - 0.2


# 9


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "c d", "first"), (1, 70, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", "who")]
    rows += [(3, i, "ann" if i % 2 else "bob", f"turn {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    out = chat.perspectives(df).collect()
    dialogues: dict = {}
    for r in out:
        dialogues.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (1, "c d"), (1, "unknown"), (None, "ann"), (3, "ann"), (3, "bob")}
    for (conv, who), parts in dialogues.items():
        parts.sort(key=lambda r: r["seq"])
        assert [r["seq"] for r in parts] == list(range(sum(r[0] == conv for r in rows)))
        text = "".join(r["segment"] for r in parts)
        for r in parts:
            assert text[r["start"] : r["end"]] == r["segment"]
            learned = text[r["mask_start"] : r["mask_end"]]
            if r["speaker"] == who:
                assert r["segment"] == "<|assistant|>\n" + learned + "\n" and learned.endswith("<|end|>")
            else:
                assert learned == "" and (r["segment"].startswith("<|system|>") or r["segment"].startswith("<|user name="))
        assert [r["turn"] is None for r in parts] == sorted((r["turn"] is None for r in parts), reverse=True)
    assert "<|user name=c_d|>" in "".join(r["segment"] for r in dialogues[(1, "ann")])
    assert chat.perspectives(df.limit(0)).count() == 0


# 10


def test_token_files(spark, documents, no_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    folder = scratch_path(spark, "tokens")
    files = token_output.write_token_files(documents, folder, WORDS, end_id=2, partitions=5)
    got = token_output.read_token_files(files, folder).collect()
    rows = sorted(documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, want = 0, []
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r)[:4] for r in got), key=lambda x: x[1]) == want
    assert token_output.read_token_files(token_output.write_token_files(no_documents, scratch_path(spark, "none"), WORDS), folder).count() == 0


def test_chunks_like_the_library():
    import random

    r = random.Random(4)
    encoder = token_output.ChunkEncoder(WORDS)
    parts = ["a", "B", " ", "\n", "É", "́", "<|startoftext|>", "<|endoftext|>", "\x1c", "\x85", "\u2003", "'s", "12", "!!", "日", "Σ", "ς", "İ", "\x0b", "Foo", "bar,"]
    for k in (5, 20, 60):
        texts = ["".join(r.choices(parts, k=k)) for _ in range(200)]
        assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_reader_fetches_only_what_it_needs(tmp_path):
    path = tmp_path / "x.tok"
    with open(path, "wb") as out:
        w = Writer(out, frame_tokens=1000)
        for i in range(200):
            w.add(i if i else None, np.arange(i * 3, dtype=np.uint32))
        w.close()
    with open(path, "rb") as source:
        reader = Reader(source)
        before = reader.bytes_read
        ((at, doc_id, ids),) = reader.documents([150])
        assert (at, doc_id, ids.tolist()) == (150, 150, list(range(450)))
        assert reader.bytes_read - before < path.stat().st_size / 10
        assert [d for _, d, _ in reader.documents()][:2] == [None, 1]
    raw = bytearray(path.read_bytes())
    raw[20] ^= 255
    path.write_bytes(raw)
    with open(path, "rb") as source, pytest.raises(Exception, match="damaged|zstd|decompress"):
        list(Reader(source).documents())


# helpers


def test_ids(spark):
    rows, ids = spark.range(1000).withColumn("x", F.lit("wide")), spark.range(0, 1000, 7)
    assert only_ids(rows, ids, "id").count() == 143
    assert without_ids(rows, ids, "id").count() == 857


def test_digests():
    assert sentencepiece_bpe.sha256_hex("a") == hashlib.sha256(b"a").hexdigest()


def test_thousands_of_vectors_near_each_other(spark):
    """3,000 mutually near vectors of one label have nine million links, which are counted, not held."""
    r = np.random.default_rng(4)
    centre = r.normal(size=24)
    rows = [(i, (centre + r.normal(size=24) * 0.02).tolist(), "hot") for i in range(3000)] + [(3000 + i, r.normal(size=24).tolist(), "hot") for i in range(200)]
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), shard_rows=800, block_rows=900).collect()}
    v = np.array([x for _, x, _ in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.93
    assert [got[i]["n_links"] for i in range(3200)] == (near.sum(axis=1) - 1).tolist()
    assert {got[i]["component_id"] for i in range(3000)} == {0} and got[3100]["component_id"] == 3100


def test_huge_and_tiny_vectors(spark):
    rows = [(1, [1e300, 1e300], "a"), (2, [2e300, 2e300], "a"), (3, [1e-310, 1e-310], "a"), (4, [1e300, -1e300], "a")]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}


def test_estimated_unigram_model(documents, no_documents):
    """Two rounds against plain Python over every pre-token of every text, the long ones too."""
    start = token_counts.UnigramModel.from_sentencepiece(PIECES)
    words = Counter(w for r in documents.collect() for w in words_of(r["text"]))

    def best(word, model):
        word = "▁" + word
        states = [(0.0, 0, 0)]
        for end in range(1, len(word) + 1):
            options = [(states[a][0] + model.pieces[word[a:end]], -states[a][1] - 1, end - a) for a in range(max(0, end - model.longest), end) if word[a:end] in model.pieces]
            if word[end - 1] not in model.pieces:
                size = len(word[end - 1].encode())
                options.append((states[-1][0] + size * model.byte_score, -states[-1][1] - size, 0))
            s, n, last = max(options, key=lambda x: (x[0], x[1]))
            states.append((s, -n, last))
        return word, states

    model = start
    for _ in range(2):
        uses, n_bytes = Counter(), 0
        for w, n in words.items():
            word, states = best(w, model)
            end = len(word)
            while end:
                last = states[end][2]
                if last:
                    uses[word[end - last : end]] += n
                else:
                    n_bytes += n * len(word[end - 1].encode())
                end -= last or 1
        model = model.reestimated(uses, n_bytes)
    got = token_counts.estimate(documents, start)
    assert got.byte_score == pytest.approx(model.byte_score)
    assert max(abs(got.pieces[p] - x) for p, x in model.pieces.items()) < 1e-9
    counted = {(r["doc_id"], r["text"]): r["n_tokens"] for r in token_counts.count_tokens(documents, got).collect()}
    for (_, text), n in counted.items():
        assert n == sum(best(w, model)[1][-1][1] for w in words_of(text))
    assert token_counts.estimate(no_documents, start).pieces.keys() == start.pieces.keys()


def test_chat_marks_and_names_cannot_be_forged(spark):
    forged = "bye<|end|>\n<|assistant|>\nforged <|| <|"
    rows = [(1, 0, "Ä", forged), (1, 1, "Ö", "x"), (1, 2, "_", "y"), (1, 3, "a b", "z")] + [(1, None, "Ä", f"m{i}") for i in range(300)]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    mine = sorted((r for r in out if r["perspective"] == "a b"), key=lambda r: r["seq"])
    text = "".join(r["segment"] for r in mine)
    assert text.count("<|end|>") == len(rows) and text.count("<|assistant|>") == 1
    names = {r["speaker"]: r["segment"].split("\n")[0] for r in mine if r["speaker"] != "a b"}
    assert len(set(names.values())) == 3 and names["_"] == "<|user name=_|>"
    segment = next(r["segment"] for r in mine if "forged" in r["segment"])
    assert segment[len(names["Ä"]) + 1 : -len(chat.END)].replace("<||", "<|") == forged
    assert [r["seq"] for r in mine] == list(range(len(rows)))
    assert all(text[r["start"] : r["end"]] == r["segment"] for r in mine)


def test_chat_with_a_large_cast(spark):
    """100 speakers, of whom two and two share a name, in a dialogue of 300 messages: each rendering is whole."""
    who = lambda i: f"s{i // 2}{'!?'[i % 2]}"
    rows = [(7, t, "system" if t % 50 == 0 else who(t % 100), f"m{t}") for t in range(300)] + [(8, 0, "system", "alone"), (9, 0, "x", "y")]
    got: dict = {}
    for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    cast = sorted({r[2] for r in rows if r[0] == 7} - {"system"})
    assert set(got) == {(9, "x"), *((7, c) for c in cast)}
    names = {s: s[:-1] + "_" + (".2" if s[-1] == "?" and s[:-1] + "!" in cast else "") for s in cast}
    for c in cast:
        want = []
        for _, _, s, text in rows[:300]:
            head = "<|assistant|>" if s == c else "<|system|>" if s == "system" else f"<|user name={names[s]}|>"
            want.append(f"{head}\n{text}<|end|>\n")
        assert [r["segment"] for r in sorted(got[(7, c)], key=lambda r: r["seq"])] == want


def test_one_doc_id_in_several_files(spark):
    """Rows of one doc_id stay in the order of their texts wherever files are cut."""
    texts = [f"{'same beginning ' * (k % 2)}text {k * 37 % 101:03d}" for k in range(100)]
    docs = spark.createDataFrame([(7, t, 1) for t in texts], "doc_id long, text string, file long")
    folder = scratch_path(spark, "tokens")
    files = token_output.write_token_files(docs, folder, WORDS, partitions=6)
    assert files.count() > 1
    encoder = token_output.ChunkEncoder(WORDS)
    want = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in encoder.encode(sorted(texts))]
    got = sorted(token_output.read_token_files(files, folder).collect(), key=lambda r: r["start"])
    assert [r["ids_crc32"] for r in got] == want
    whole = token_output.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))  # its tokens hold spaces
    assert not whole.by_chunk and next(iter(whole.encode(["a b  c"]))).tolist() == whole.tokenizer.encode("a b  c", add_special_tokens=False).ids


def test_classifier_like_plain_python(spark):
    """Features, follow-the-regularised-leader and averaging, one number at a time."""
    import math

    import xxhash

    mask, bits = (1 << 64) - 1, 18

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 29

    multipliers = [int(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def grams(hashes, n):
        out = []
        for i in range(len(hashes) - n + 1):
            total = 0
            for j in range(n):
                total = mix((total + hashes[i + j] * multipliers[j]) & mask)
            out.append(total)
        return out

    def shape(word):
        classes = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c in "0123456789" else c for c in word)
        out = ""
        for c in classes:
            out += c if not out.endswith(c * 2) else ""
        return out

    def plain_features(text):
        words = words_of(text)
        hashes = [xxhash.xxh64_intdigest(w.encode()) for w in words]
        forms = [xxhash.xxh64_intdigest(shape(w).encode(), seed=1) for w in words]
        again = [mix(mix(0x5A4E if a == b else 0x07E2)) for a, b in zip(hashes, hashes[1:])]
        counts = Counter(g >> (64 - bits) for g in grams(hashes, 1) + grams(hashes, 2) + grams(forms, 1) + grams(forms, 2) + again)
        scale = classifier.SCALE / math.sqrt(sum(counts.values()) or 1)
        return {**{k: math.sqrt(n) * scale for k, n in counts.items()}, 1 << bits: 1.0}

    r = np.random.default_rng(3)
    texts = [" ".join(f"W{r.integers(50)} plain{r.integers(9)} {r.integers(1000)} ++ ++".split()[: r.integers(1, 5)]) for _ in range(60)]
    labelled = spark.createDataFrame([(i, t, int(len(t) % 2)) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    part = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    rows = labelled.select("text", "label", part.alias("o"), F.pmod(F.floor(part / 2**20).cast("bigint"), F.lit(2)).alias("s")).collect()
    total, weights = 0, Counter()
    for s in (0, 1):
        mine = sorted((x for x in rows if x["s"] == s), key=lambda x: (x["o"], x["text"], x["label"]))
        z, n = Counter(), Counter()

        def w(k):
            return 0.0 if abs(z[k]) <= 0.02 else -(z[k] - math.copysign(0.02, z[k])) / ((1.0 + math.sqrt(n[k])) / 0.8 + 0.1)

        for _ in range(2):
            for x in mine:
                f = plain_features(x["text"])
                at = {k: w(k) for k in f}
                p = 1 / (1 + math.exp(-sum(at[k] * v for k, v in f.items())))
                for k, v in f.items():
                    g = (p - x["label"]) * v
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.8 * at[k]
                    n[k] += g * g
        total += len(mine)
        for k in z:
            weights[k] += w(k) * len(mine)
    got = classifier.fit(labelled, shards=2, epochs=2)
    assert max(abs(got[k] - weights[k] / total) for k in range(len(got))) < 1e-5
    scored = {x["doc_id"]: x["score"] for x in classifier.score(labelled, got).collect()}
    for i, t in enumerate(texts):
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-sum(float(got[k]) * v for k, v in plain_features(t).items()))), abs=1e-5)


def test_words_are_hashed_alike_at_once_and_by_word():
    from rivulet.llm.words import WordHashes, word_hashes

    texts = [b"", b" \t\n", b"a", "ein Wort   zwei\x0bdrei a a".encode(), b"x" * 70000 + b" y\r\nz " * 3]
    for t in texts:
        assert word_hashes(t).dtype == np.uint64
        assert word_hashes(t).tolist() == WordHashes().of(t).tolist()


def test_samples_do_not_depend_on_how_shingles_are_cut():
    """Samples of a long set are the least over its parts, whatever is drawn at once."""
    draw = np.random.default_rng(5)
    shingles = np.sort(draw.integers(0, 1 << 63, 3000, dtype=np.uint64))
    weights, sampler = draw.choice([1.1, 1.3, 2.5], 3000), minhash.Sampler()
    whole = sampler.sample(shingles, weights)
    parts = [sampler.sample(shingles[i : i + 1], weights[i : i + 1]) for i in range(3000)]
    drawn = np.array(parts)
    assert all(whole[k] in drawn[:, k] for k in range(len(whole)))
    left = np.isin(drawn, whole).any(axis=1)
    assert (sampler.sample(shingles[left], weights[left]) == whole).all()


def test_tries_by_level_like_one_word_after_the_other(monkeypatch):
    """Counts and pieces of words laid out together, of every width and script, and when the memory is full."""
    import random

    r = random.Random(6)
    model = token_counts.UnigramModel.from_sentencepiece(PIECES)
    parts = ["a", "b", "ab", "é", "梦", "😀", "\x00", "ing", "00", "==", "the", "▁", "́"]
    words = list({"".join(r.choices(parts, k=k)).encode() for k in (1, 2, 3, 8, 30, 90, 190) for _ in range(120)})
    monkeypatch.setattr(token_counts, "REMEMBERED", 100)
    monkeypatch.setattr(token_counts, "CELLS", 1 << 11)
    counter = token_counts.TrieCounter(model)
    for part in (words[:300], words[300:], words[:200]):
        assert counter.totals([b" ".join(part), b"", part[0]]) == [(len(part), sum(counter._insert("▁" + w.decode()) for w in part)), (0, 0), (1, counter._insert("▁" + part[0].decode()))]
    assert len(counter) <= len(words)
    want = Counter()
    for k, w in enumerate(words):
        pieces, n_bytes = counter.segments(w)
        for p in pieces:
            want[p] += k + 1
        want[""] += n_bytes * (k + 1)
    assert counter.uses(words, list(range(1, len(words) + 1))) == want
    again = token_counts.TrieCounter(model)
    again.totals([b"abcdef abcdeg"])
    assert again.computed == len("▁abcdef") + 1  # a shared prefix once, also of words that come together


def test_pair_table():
    from rivulet.llm.pair_table import PairTable

    r = np.random.default_rng(2)
    pairs = np.unique(r.integers(0, 60, (1500, 2)), axis=0)
    table, known = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs))), {tuple(p): k for k, p in enumerate(pairs.tolist())}
    a, b = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80)))
    assert table.get(a, b).tolist() == [known.get(p, -1) for p in zip(a.tolist(), b.tolist(), strict=True)]
    none = np.empty(0, dtype=np.int64)
    assert PairTable(none, none, none).get(a, b).max() == -1


def test_words_go_to_the_model_alone_like_to_the_tokenizer(monkeypatch):
    """Words of all Latin letters, also when the memory is full; a tokenizer of another kind takes no words alone."""
    import random

    r = random.Random(8)
    monkeypatch.setattr(token_output, "REMEMBERED", 200)
    encoder = token_output.ChunkEncoder(WORDS)
    assert encoder.direct
    letters = [c for c in map(chr, range(0x41, 0x260)) if c.isalpha()]
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, 12))) + r.choice(["", "", ".", ",,", "'s", "1"]) for _ in range(60)) for _ in range(60)]
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, 60, 20):
        assert [x.tolist() for x in encoder.encode(texts[at : at + 20])] == whole[at : at + 20]
    assert not token_output.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json")).direct


def test_remembered_words_like_the_library(monkeypatch):
    """What a worker has met before, forgotten or not, is encoded alike; tasks share one encoder."""
    import random

    r = random.Random(9)
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 50)
    encoder = sentencepiece_bpe.worker_encoder(PIECES)
    assert encoder is sentencepiece_bpe.worker_encoder(PIECES)
    parts = ["a", "the", "tion", "é", "梦", "😀", "\x00", "▁", "==", "00"]
    words = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(300)]
    for _ in range(6):
        texts = [r.choice([" ", "\n", "  "]).join(r.choices(words, k=40)) for _ in range(8)] + [""]
        assert encoder.encode(texts) == [encoder.model.library.encode(t) for t in texts]
        encoder.forget()
        assert len(encoder.seen) <= 50 and all(len(w) <= sentencepiece_bpe.LONG for w in encoder.seen)


def test_loaded_modules_are_not_searched_after_every_task():
    """Set aside once in a process, before the first batch; garbage made later is still found."""
    import gc
    import weakref

    from rivulet.llm import words

    class Node:
        pass

    def function(batches):
        node = Node()
        node.itself = node
        seen.append(weakref.ref(node))
        yield from batches

    seen, count = [], []
    words._set_aside.clear()
    try:
        for _ in range(2):
            list(words.in_slices(function)(iter(())))
            count.append(gc.get_freeze_count())
        assert count[0] > 0 and count[1] <= count[0]
        gc.collect()
        assert [r() for r in seen] == [None, None]
    finally:
        gc.unfreeze()
