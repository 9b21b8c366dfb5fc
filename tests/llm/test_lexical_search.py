"""Ranked search against plain scoring of all documents (its SQL is compared in test_operators)."""

import math
import re
from collections import Counter

import numpy as np

from kinframe.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top):
    found = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for i, t in items:
        asked = sorted(set(TERM.findall((t or "").translate(LOWER))))
        got = []
        for d, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in asked if x in c)
            if s > 0:
                got.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(got)[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "- -- ."), (4, "Straße ÄPFEL apfel"), (5, "straSSe straße Äpfel"), (None, "apfel apfel 42"), (7, "a1-b2_c3"), (7, "a1-b2_c3"), (6, "a1 b2 c3"), (8, "common " * 30_000), *[(n, "common word here") for n in range(100, 130)]]
    items = [(1, "ÄPFEL straße"), (2, "A1 b2"), (3, None), (4, "..."), (5, "common"), (6, "absent"), (None, "apfel"), (7, "word WORD word here")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int")
    ask = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    want = plain(docs, items, 10)
    assert {r[0] for r in want} == {None, 1, 2, 5, 7}  # ties of 30 copies are cut by id
    assert rows(S.ranked(df, ask)) == want
    assert rows(S.ranked(df, ask, pairs=2)) == want  # one pass for each item or two
    assert rows(S.ranked(df, ask, top=3)) == plain(docs, items, 3)
    for a, b in ((df.where("false"), ask), (df, ask.where("false"))):
        assert S.ranked(a, b).collect() == []


def test_small_sorts(spark, monkeypatch):
    """Documents' ranges of a few rows give the same."""
    monkeypatch.setattr(S, "TOGETHER", 3)
    rnd = np.random.default_rng(1)
    docs = [(int(i), " ".join(f"w{x}" for x in rnd.zipf(1.5, rnd.integers(0, 30)) % 60)) for i in range(300)]
    items = [(int(i), " ".join(f"w{x}" for x in rnd.integers(0, 60, 6))) for i in range(12)]
    got = S.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain(docs, items, 10)


def test_radix_order():
    rnd = np.random.default_rng(2)
    for top in (1, 1 << 15, 1 << 31, 1 << 62):
        keys = rnd.integers(0, top, 5000).astype(np.uint64)
        assert (S.by_radix(keys) == np.argsort(keys, kind="stable")).all()
    assert len(S.by_radix(np.empty(0, np.uint64))) == 0
