"""The pipeline's near-copy stage against the Jaccard similarity of all pairs of documents."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as P
from kinframe.llm import simhash

from .brute import union_find


def shingles(text, k=5):
    fold = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
    w = (text or "").encode("utf-8", "replace").translate(fold).split()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def groups(rows):
    """The smallest id of each group that pairs of Jaccard similarity 0.8 or more join; every pair with a common shingle is tried."""
    s = {d: shingles(t) for d, t in rows}
    common, at = defaultdict(int), defaultdict(list)
    for d, x in s.items():
        for h in x:
            at[h].append(d)
    for ds in at.values():
        for p in combinations(sorted(ds), 2):
            common[p] += 1
    links = [p for p, n in common.items() if n >= 0.8 * (len(s[p[0]]) + len(s[p[1]]) - n)]
    return union_find(s, links), links


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_jaccard(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, links = groups(rows)
    fp = {d: simhash.fingerprint(t, 5) & (1 << 64) - 1 for d, t in rows}
    assert any(bin(fp[a] ^ fp[b]).count("1") > 4 for a, b in links)  # what a radius of 4 misses
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, None).collect()} == set(want.values())


def test_edge_of_similarity(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; k of them go with the last k words
    docs = [(1, " ".join(words)), (2, " ".join(words[:84])), (3, " ".join(words[:83])), (4, ""), (5, None), (6, "a b"), (7, "A\tB ")]
    other = [(10, " ".join(f"x{i}" for i in range(104))), (11, " ".join(f"x{i}" for i in range(83)))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(docs + other, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 10: 10, 11: 11}


@pytest.mark.parametrize(("share", "small"), [(0.64, 4096), (0.70, 300)])
def test_pairs_inside_a_family(spark, monkeypatch, share, small):
    """1,200 texts of one template, whose mean similarity is ``share``, hold 600 pairs at some 0.82: none may be lost."""
    import random

    monkeypatch.setattr(simhash, "SMALL", small)  # sets of more than 300 are decided by a join
    rnd = random.Random(7)
    template = [f"t{i}" for i in range(400)]
    texts = []
    for n in range(600):
        own = list(template)
        for k, p in enumerate(rnd.sample(range(5, 395, 6), round(39.6 * (1 - share) / (1 + share)))):  # each takes five shingles
            own[p] = f"x{n}_{k}"
        other = list(own)
        at = rnd.randrange(0, 360)
        other[at : at + 35] = [f"y{n}_{i}" for i in range(35)]
        texts += [" ".join(own), " ".join(other)]
    rows = list(enumerate(texts))
    s = [shingles(t) for t in texts]
    jaccard = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    assert all(0.8 <= jaccard(2 * n, 2 * n + 1) < 0.89 for n in range(600))
    some = [jaccard(*rnd.sample(range(0, 1200, 2), 2)) for _ in range(500)]
    assert abs(sum(some) / 500 - share) < 0.06
    number = {x: k for k, x in enumerate({x for t in s for x in t})}
    held = np.zeros((len(s), len(number)), dtype=np.float32)
    for i, t in enumerate(s):
        held[i, [number[x] for x in t]] = 1
    common, size = held @ held.T, held.sum(axis=1)
    i, j = np.nonzero(np.triu(common >= 0.8 * (size[:, None] + size - common), 1))
    want = union_find(range(1200), list(zip(i.tolist(), j.tolist())))
    assert len(i) >= 600 and len(set(want.values())) > 500
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
