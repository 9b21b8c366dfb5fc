"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from kinframe.llm import periodic_runs as P
from kinframe.llm import queries as Q


def plain(w):
    """(start, length, period) of all runs: every period is tried at every place."""
    n, out = len(w), {}
    w = np.unique(np.array(w), return_inverse=True)[1] if n else np.empty(0)
    for q in range(1, n // 3 + 1):
        same = np.concatenate(([0], w[:-q] == w[q:], [0])).astype(np.int8)
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
    return sorted(((a, m, q) for (a, m), q in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=repr)


def test_query_equals_plain_search(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        got = rows(Q.op13_periodic_runs(spark, d))
        assert got == sorted((expected(r.doc_id, r.text) for r in docs), key=repr)
        assert sum(r[1] > 0 for r in got) > 10


def test_random_words():
    rnd, total = random.Random(5), 0
    for _ in range(300):
        k, w = rnd.choice([1, 2, 3, 50]), []
        while len(w) < rnd.choice([24, 80, 500]):
            p = [rnd.randrange(k) for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64]))]
            w += (p * 7)[: int(len(p) * rnd.uniform(0.5, 6))]
        w = w * 3 if rnd.random() < 0.3 else w
        want = plain(w)
        total += len(want)
        assert P.runs_of(np.array(w, dtype=np.int64)) == want
    assert total > 300


def test_edges(spark):
    long = ["a"] * 50_000
    texts = [None, "", " \t\n", "a " * 23, "a " * 24, " ".join(["a b"] * 12), "x y " * 24, " ".join(long), "a " * 24, ("p q r " * 9) + "s " * 30]
    data = [(i, t, "r", "c", [i]) for i, t in enumerate(texts)] + [(None, "a " * 30, "r", "c", [0])] + [(3, "a " * 23, "r", "c", [3])]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string, collapsed string, strongest array<int>")
    found = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert [len(found[i].runs) for i in range(len(texts))] == [0, 0, 0, 0, 1, 1, 1, 1, 1, 2]
    assert found[0].collapsed == found[2].collapsed == "" and found[4].collapsed == "a" and found[5].collapsed == "a b" and found[7].collapsed == "a"
    assert [tuple(r) for r in found[9].runs] == [(0, 27, 3), (27, 30, 1)] and found[9].strongest == 1 and found[9].collapsed == "p q r s"
    assert tuple(found[None].runs[0]) == (0, 30, 1)
    assert rows(P.digests(P.periodic_runs(docs, rewrite=P.with_planted_period))) == sorted((expected(d[0], d[1]) for d in data), key=repr)
    assert P.digests(P.periodic_runs(docs.where("false"))).collect() == []
