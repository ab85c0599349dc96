from __future__ import annotations

import random

import pytest

LONG = " ".join(f"w{i % 997}" for i in range(30_000))


@pytest.fixture(scope="session")
def texts():
    """Texts with every odd case: null, empty, blank, one word, very long, copies, near copies, other scripts."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(400)]
    plain = [" ".join(r.choices(words, k=r.randint(40, 120))) for _ in range(30)]
    near = [" ".join([*p.split()[:-1], "changed"]) for p in plain[:8]]
    odd = [None, "", " \t\n", "one", "two words", LONG, "x" * 3000, "É́ñ ﬁ 日本 😀 <|endoftext|> </s> ▁▁ a  b", "line\n\nline\nline\r\n", "!! ## $$ %% & | < >"]
    return [*plain, *plain[:5], *near, *odd, *odd[:4]]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With a null and a repeated doc_id, null sources, and columns whose names operators use themselves."""
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 0 if t is None else len(t), 7, f"k{i}") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 5, 7, "again"), (None, "a text without a number and with quite a few words", "en", "s1", 3, 7, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, kept string")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
