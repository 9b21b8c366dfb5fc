"""Clips of the whole table against brute force."""

import random

import numpy as np
import pytest

from kinframe import queries as Q
from kinframe.operators import clips as CL

SF = "/root/testdata/sf0.001"


def brute(videos, least=0.8):
    """{clip: (source, offset)}: each clip at the best place in the longest source that holds it."""
    out = {}
    order = sorted(videos, key=lambda v: (-v.duration_s, v.id))
    for c in order:
        for s in order:
            if c.id == s.id or not 0.1 <= c.duration_s / s.duration_s < 0.95 or len(c.fp) >= len(s.fp):
                continue
            bits = [sum((x ^ y).bit_count() for x, y in zip(c.fp, s.fp[o:])) for o in range(len(s.fp) - len(c.fp) + 1)]
            if min(bits) <= int(np.float32((np.float32(1) - np.float32(least)) * np.float32(len(c.fp) * 32))):
                out[c.id] = s.id, bits.index(min(bits))
                break
    return out


def test_whole_table(spark):
    want = brute(Q.videos(spark, SF).collect())
    got = Q.queries()["clip_items"](spark, SF).collect()
    assert {r.id: (r.group_id, r.offset_s) for r in got if r.is_clip} == want
    assert {r.id for r in got if not r.is_clip} == {s for s, _ in want.values()}
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert {6 * k + 1 for k in range((n // 12 + 2) // 3)} <= set(want)


@pytest.mark.parametrize("least", [0.8, 0.9, 0.72, 0.5])
def test_seeds_lose_nothing(spark, least):
    """Clips of odd and even lengths with noise up to the budget, silent stretches, constant values."""
    rnd = random.Random(3)
    fp = lambda n: [rnd.getrandbits(32) for _ in range(n)]
    rows, n = [], 0
    for k in range(14):
        source = fp(40)
        if k % 4 == 0:
            source[10:25] = [0] * 15
        if k % 4 == 1:
            source[5:30] = [7] * 25
        rows.append((n, 200.0 + k, source))
        for size in (2, 3, 5, 8, 13, 20):
            n += 1
            at = rnd.randrange(0, 40 - size)
            clip, budget = source[at : at + size], int(np.float32((np.float32(1) - np.float32(least)) * np.float32(size * 32)))
            for b in rnd.sample(range(size * 32), budget + (size % 3 == 0)):  # some are one bit over
                clip[b // 32] ^= 1 << b % 32
            rows.append((n, 30.0 + n / 10, clip))
        n += 1
    rows.append((n + 1, 100.0, [0] * 30))
    videos = CL.by_duration(spark.createDataFrame(rows, "id long, duration_s double, fp array<long>"))
    got = {(r.source_id, r.clip_id): (r.offset_s, round(r.similarity, 6)) for r in CL.clip_matches(videos, 0.1, least).collect()}
    want = {}
    for i, d, x in rows:
        for j, e, y in rows:
            if i != j and 0.1 <= e / d < 0.95 and len(y) < len(x):
                bits = [sum((p ^ q).bit_count() for p, q in zip(y, x[o:])) for o in range(len(x) - len(y) + 1)]
                if min(bits) <= int(np.float32((np.float32(1) - np.float32(least)) * np.float32(len(y) * 32))):
                    want[i, j] = bits.index(min(bits)), round(1 - min(bits) / (32 * len(y)), 6)
    assert got == want and len(want) > 40


def test_constant_stretches_are_one_code(spark):
    videos = spark.createDataFrame([(1, [0] * 1000 + [5, 6] + [9] * 500), (2, [1, 2])], "id long, fp array<long>")
    got = sorted((r.id, r.first, r.last) for r in CL._runs(videos, 1).collect())
    assert got == [(1, 0, 998), (1, 999, 999), (1, 1000, 1000), (1, 1001, 1001), (1, 1002, 1500), (2, 0, 0)]
    assert sorted((r.first, r.last) for r in CL._runs(videos, 2).where("id = 1").collect()) == [(0, 998), (1000, 1000), (1002, 1500)]
