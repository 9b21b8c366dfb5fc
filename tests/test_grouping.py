"""Groups over many tasks against the sequential rule, and splits against a plain one."""

import random

import numpy as np
import pytest

from kinframe.config import ScanConfig
from kinframe.operators import grouping as G

HASH = ScanConfig(whole_catalog=True, percent=90.0, use_phash=True)


def plain_split(ids: list[int], linked) -> list[list[int]]:
    """The rule, a member and a test of two at a time."""
    work, done = [list(ids)], []
    while work:
        now = work.pop(0)
        if len(now) < 2:
            continue
        if len(now) == 2:
            done.append(now)
            continue
        link = {i: {j for j in now if j != i and linked(i, j)} for i in now}
        stay, gone = list(now), []
        degree = {i: len(link[i]) for i in now}  # links among those that stay
        while len(stay) > 1:
            least = min(stay, key=degree.__getitem__)  # the first of the least linked
            if degree[least] >= len(stay) // 2:
                break
            stay.remove(least)
            gone.append(least)
            for j in link[least]:
                degree[j] -= 1
        if len(stay) > 1:
            done.append(stay)
        left = set(gone)
        for i in gone:
            if i in left:
                part, todo = [], [i]
                left.discard(i)
                while todo:
                    x = todo.pop()
                    part.append(x)
                    near = sorted(link[x] & left)
                    left -= set(near)
                    todo += near
                if len(part) < len(now):
                    work.append(sorted(part, key=now.index))
    return done




def sequential(hashes, pairs, config):
    members = {i: {"image": False, "hashes": (h,), "frame": None, "positions": 1} for i, h in hashes.items()}
    return {i: (x["group"], x["difference"], x["flipped"]) for i, x in G.resolve(members, pairs, G.similarity_test(config)).items()}


def distributed(spark, hashes, pairs, config, per_task):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    members = spark.createDataFrame([(i, False, [signed(h)], None) for i, h in hashes.items()], "id long, image boolean, hashes array<long>, frame binary")
    edges = spark.createDataFrame([(0, *p) for p in pairs], "part long, a_id long, b_id long, difference double, flipped boolean").repartition(7)
    return {r.id: (r.rep, r.difference, r.flipped) for r in G.resolved(members, edges, config, 1, per_task).collect()}


def graph(rnd, n, m, spread):
    """Hashes in a few neighbourhoods and pairs of any of them, so that some tests of representatives fail."""
    centres = [rnd.getrandbits(64) for _ in range(3)]
    flip = lambda h: h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, spread)))
    hashes = {i: flip(rnd.choice(centres)) for i in range(n)}
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
    return hashes, [(a, b, round(rnd.random(), 3), rnd.random() < 0.3) for a, b in sorted(pairs)]


@pytest.mark.parametrize(("n", "m", "per_task"), [(40, 70, 30), (200, 1500, 300)])
def test_reservations_equal_the_order(spark, n, m, per_task):
    hashes, pairs = graph(random.Random(n), n, m, 8)
    want = sequential(hashes, pairs, HASH)
    assert distributed(spark, hashes, pairs, HASH, per_task) == want
    assert len({g for g, _, _ in want.values()}) > 1


def test_chains_and_stars(spark):
    rnd = random.Random(4)
    hashes = {i: rnd.getrandbits(6) for i in range(120)}  # all alike
    chain = [(i, i + 1, 0.1, False) for i in range(119)]
    star = [(0, i, 0.2, True) for i in range(1, 120)]
    for pairs in (chain, star):
        assert distributed(spark, hashes, pairs, HASH, 60) == sequential(hashes, pairs, HASH)


def test_one_large_component_over_many_tasks(spark):
    """20,000 members in one component, of which no task may resolve more than 5,000 pairs."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    hashes = {i: base ^ (1 << rnd.randrange(64)) for i in range(20_000)}
    pairs = [(0, i, 0.1, False) for i in range(1, 20_000)] + [(i, i + 1 + rnd.randrange(50), 0.2, True) for i in range(1, 19_000, 2)]
    want = sequential(hashes, pairs, HASH)
    assert distributed(spark, hashes, pairs, HASH, 5_000) == want and len(want) == 20_000


def test_peel_equals_plain_split():
    rnd = np.random.default_rng(6)
    for _ in range(300):
        n, p = int(rnd.integers(0, 40)), rnd.random()
        link = np.triu(rnd.random((n, n)) < p, 1)
        link |= link.T
        ids = sorted(rnd.choice(1000, n, replace=False).tolist())
        at = {x: k for k, x in enumerate(ids)}
        assert G.peel(ids, link) == plain_split(ids, lambda i, j: bool(link[at[i], at[j]]))  # noqa: B023


@pytest.mark.parametrize("config", [ScanConfig(percent=90.0, positions=2, use_phash=True), ScanConfig(percent=80.0, positions=2), ScanConfig(percent=80.0, positions=2, ignore_black=True)])
def test_link_matrix_equals_the_test(config):
    rnd = np.random.default_rng(7)
    base = rnd.integers(0, 256, 128)
    members = []
    for k in range(60):
        image, noise = k % 5 == 0, int(rnd.integers(1, 120))
        frame = np.clip(base + rnd.integers(-noise, noise + 1, 128), 0, 255).astype(np.uint8).tobytes()
        hashes = (None, 5) if k % 11 == 0 else () if k % 13 == 0 else tuple(int(x) for x in rnd.integers(0, 1 << 8, 2))
        members.append({"image": image, "hashes": hashes, "frame": None if k % 17 == 0 else frame[: 64 if image else 128], "positions": 2})
    similar = G.similarity_test(config)
    want = np.array([[i != j and similar(x, y) for j, y in enumerate(members)] for i, x in enumerate(members)])
    assert (G.link_matrix(members, config) == want).all() and want.any()
