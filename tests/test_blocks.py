"""Frame comparison, duration buckets, positions and the representatives' test against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe import queries as Q
from kinframe.config import ScanConfig
from kinframe.operators import blocks, grouping, pairs
from kinframe.plans.engine import MediaEngine
from kinframe.sources import adapters
from kinframe.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("percent", "least", "most"), [(20, 0, 0), (20, 5, 0), (10, 2, 60), (5, 0, 30), (0, 3, 7), (0, 0, 0), (50, 100, 10), (1, 0.5, 0)])
def test_durations_within_tolerance_are_near(spark, percent, least, most):
    c = ScanConfig(duration_percent=percent, duration_min_s=least, duration_max_s=most)
    d = sorted({*np.random.default_rng(1).uniform(0, 4000, 300).round(2).tolist(), *(float(x) for x in range(0, 400, 7)), 0.0, 25.0, 600.0})
    x = spark.createDataFrame([(i, v, False) for i, v in enumerate(d)], "id long, duration_s double, is_image boolean")
    at = {r.id: r.b for r in x.select("id", blocks.duration_bucket(F.col("duration_s"), c).alias("b")).collect()}

    def tolerance(v):
        if percent <= 0:
            return max(least, most)
        t = max(v * (percent / 100), least) if least > 0 else v * (percent / 100)
        return min(t, most) if most > 0 else t

    near = {(i, j) for i, j in itertools.combinations(range(len(d)), 2) if abs(d[i] - d[j]) <= min(tolerance(d[i]), tolerance(d[j]))}
    assert all(0 <= at[j] - at[i] <= 2 for i, j in near)
    got = {(r.a, r.b) for r in pairs.duration_pairs(x, c, []).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()}
    assert got == near


def test_bounded_differences_are_exact():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 256, (30, 2048), dtype=np.uint8)
    b = np.clip(a[::-1].astype(int) + rng.integers(-20, 21, a.shape), 0, 255).astype(np.uint8)
    whole = blocks._differences(a, b, 2, False, False)
    for limit in (0.02, 0.04, 0.3, 0.34):
        got = blocks._bounded(a, b, 2, limit)
        assert (np.isinf(got) | (np.abs(got - whole) < 1e-12)).all() and not np.isinf(got[whole <= limit]).any()
    assert np.isinf(blocks._bounded(a, b, 2, 0.04)).mean() > 0.9


def items(n=60, side=8, positions=2):
    rng, out = np.random.default_rng(3), []
    for i in range(n):
        image = i % 5 == 0
        k = 1 if image else positions
        f = rng.integers(0, 256, (k, side * side))
        if i % 4 == 3 and len(out[-1][2]) == k:  # like the one before, some mirrored, some dark
            f = np.clip(np.array([np.frombuffer(x, dtype=np.uint8) for x in out[-1][2]]).astype(int) + rng.integers(-2, 3, (k, side * side)), 0, 255)
            if i % 8 == 7:
                f = f.reshape(k, side, side)[:, :, ::-1].reshape(k, -1)
        if i % 9 == 4:
            f[:, : side * side // 2] = 5
        out.append((i, 100.0 + i % 7, [x.astype(np.uint8).tobytes() for x in f], image))
    return out


@pytest.mark.parametrize(("black", "flipped", "percent"), [(False, False, 96.0), (True, False, 96.0), (False, True, 96.0), (True, True, 70.0), (False, False, 60.0)])
def test_frame_matches(spark, monkeypatch, black, flipped, percent):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    c = ScanConfig(percent=percent, ignore_black=black, flipped=flipped, positions=2)
    rows = items()

    def difference(x, y):
        each = []
        for p, q in zip(x, y):
            p, q = (np.frombuffer(v, dtype=np.uint8).astype(int) for v in (p, q))
            keep = (p > 0x20) & (q > 0x20) if black else np.ones(len(p), dtype=bool)
            each.append(np.abs(p - q)[keep].sum() / keep.sum() / 256 if keep.any() else float("nan"))
        return float(np.mean(each))

    mirror = lambda x: [np.frombuffer(v, dtype=np.uint8).reshape(8, 8)[:, ::-1].tobytes() for v in x]
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a[3] != b[3] or (not a[3] and abs(a[1] - b[1]) > 0.2 * min(a[1], b[1])):
            continue
        plain, flip = difference(a[2], b[2]), False
        if flipped:
            m = difference(mirror(a[2]), b[2])
            if m == m and not plain <= m:
                plain, flip = m, True
        if np.float32(plain) <= np.float32(c.limit):
            want[a[0], b[0]] = (round(plain, 5), flip)
    df = spark.createDataFrame(rows, "id long, duration_s double, frames array<binary>, is_image boolean").repartition(5)
    found = blocks.frame_matches(df, c).collect()
    got = {(r.a_id, r.b_id): (round(r.difference, 5), r.flipped) for r in found}
    assert set(got) == set(want) and len(found) == len(got)
    assert {k for k in want if abs(got[k][0] - want[k][0]) > 2e-5 or got[k][1] != want[k][1]} == set()
    assert blocks.frame_matches(df.limit(0), c).count() == 0
    empty = df.withColumn("frames", F.when(F.col("id") != 3, F.col("frames")))
    assert not [1 for r in blocks.frame_matches(empty, c).collect() if 3 in (r.a_id, r.b_id)]


def catalog(spark, rows, **more):
    same = {"size": F.lit(10), "width": F.lit(640), "height": F.lit(480), "folder": F.lit("/m"), "file_id": F.col("id"), "path": F.concat(F.lit("/m/"), F.col("id").cast("string"), F.lit(".mp4")), "duration_s": F.lit(10.0)}
    return rows.withColumns({**same, **more})


def test_hashes_of_every_position_and_mirrored_ones(spark):
    """Videos go by all positions' hashes, images by frames; a missing hash matches nothing; mirrored hashes count if they are better."""
    one, other = 0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0F ^ 0x3FFFFFF  # plain hashes of mirrored pairs must pass the quick gate, too
    far = one ^ 0xFFFF0000
    rows = [(1, [one, other], [far, far], False), (2, [one ^ 1, other ^ 3], [far, far], False), (3, [one, far], [far, other], False), (4, [one, None], [None, None], False), (5, [far, far], [other, other], False), (6, None, None, False), (7, [one, other, one], None, False)]
    df = spark.createDataFrame([(i, h, f, m, [b"\x10" * 64] * 2) for i, h, f, m in rows] + [(8, None, None, True, [b"\x40" * 64]), (9, None, None, True, [b"\x41" * 64])], "id long, hashes array<long>, flipped_hashes array<long>, is_image boolean, frames array<binary>")
    x = catalog(spark, df)
    c = ScanConfig(whole_catalog=True, positions=2, percent=96.0, use_phash=True)
    told = lambda c: {(r.a.id, r.b.id): (round(r.difference, 6), r.flipped) for r in pairs.all_matches(x, c).collect()}
    assert told(c) == {(1, 2): (round(3 / 2 / 64, 6), False), (8, 9): (round(1 / 256, 6), False)}
    mirrored = told(ScanConfig(whole_catalog=True, positions=2, percent=96.0, use_phash=True, flipped=True))
    assert mirrored[1, 5] == (0.0, True) and mirrored[2, 5] == (0.0, True) and mirrored[1, 2] == told(c)[1, 2]


def test_masks_hold_for_representatives():
    """Two frames that differ only where one is black are alike under the mask, not without it."""
    a = {"image": False, "hashes": (), "frame": bytes([100] * 64), "positions": 1}
    b = {**a, "frame": bytes([100] * 32 + [0] * 32)}
    assert grouping.similarity_test(ScanConfig(ignore_black=True))(a, b) and not grouping.similarity_test(ScanConfig())(a, b)
    assert not grouping.similarity_test(ScanConfig(use_phash=True))(a, b)  # no hashes


def test_engine_groups_equal_a_plain_model(spark):
    """duplicate_groups on the smallest tables against resolve() and split_chains() run over all pairs in one process."""
    c = Q.CONFIG
    rows = {r.id: r for r in D.items(spark, SF).collect()}
    bits = lambda a, b: bin(a.lo ^ b.lo).count("1") + bin(a.hi ^ b.hi).count("1")
    sad = lambda a, b: float(np.abs(np.array(a.frame) - np.array(b.frame)).sum()) / 64 / 256
    half = lambda x, y: min(x, y) >= max(x, y) // 2
    found = []
    for i, j in itertools.combinations(sorted(rows), 2):
        a, b = rows[i], rows[j]
        gate = a.is_image == b.is_image and bits(a, b) <= 32 and (a.is_image or abs(a.duration_s - b.duration_s) <= 0.2 * min(a.duration_s, b.duration_s)) and int(a.size * 0.5) <= b.size <= int(a.size * 1.5) and half(a.width, b.width) and half(a.height, b.height) and a.file_id != b.file_id
        if gate and np.float32(sad(a, b)) <= np.float32(c.limit):
            found.append((i, j, sad(a, b), False))
    similar = lambda x, y: np.float32(sad(rows[x], rows[y])) <= np.float32(c.limit)
    grouped = grouping.resolve({i: i for i in rows}, found, similar)
    parts = {}
    for i, g in grouped.items():
        parts.setdefault(g["group"], []).append(i)
    want = {}
    for ids in parts.values():
        for p in grouping.split_chains(sorted(ids), similar) if len(ids) > 2 else [ids]:
            want |= {i: (min(p), round(100 * (1 - grouped[i]["difference"]), 3)) for i in p}
    got = {r.id: (r.group_id, round(r.similarity, 3)) for r in MediaEngine(spark, c).run(D.items(spark, SF)).collect()}
    assert got == want and len(want) > 50


def test_gathering_sets_flags(spark):
    files = [("/a", 0), ("/b", 0), ("/c", 4), ("/d", 0), ("/e", 8), ("/f", 0)]
    df = spark.createDataFrame(files, "path string, flags int")

    def decode(path, positions):
        from kinframe.sources import adapters as A

        if path == "/b":
            raise A.MetadataError
        if path == "/d":
            raise A.FrameError
        return A.Decoded('{"format":{}}', [bytes([0 if path == "/f" else 90] * 1024) for _ in positions], [0, 0] if path == "/a" else None if path == "/f" else [7, 9])

    got = {r.path: r for r in adapters.gather(df, decode, ScanConfig(positions=3)).collect()}
    assert {p: r.flags for p, r in got.items()} == {"/a": 128, "/b": 8, "/c": 4, "/d": 4, "/e": 8, "/f": 16 | 32}
    assert len(got["/a"].frames) == 3 and got["/c"].frames is None
    again = {r.path: r.flags for r in adapters.gather(df, decode, ScanConfig(retry_errors=True)).collect()}
    # frames of which one is dark don't flag a file, as long as another isn't
    mixed = lambda path, positions: adapters.Decoded(None, [bytes([0 if k % 2 else 90] * 1024) for k, _ in enumerate(positions)], [1])
    assert {r.flags for r in adapters.gather(df.where("flags = 0"), mixed, ScanConfig(positions=3)).collect()} == {0}
    assert again == {"/a": 128, "/b": 8, "/c": 0, "/d": 4, "/e": 0, "/f": 48}


def test_only_missing_positions_are_decoded(spark, tmp_path):
    log = str(tmp_path / "calls")

    def decode(path, seconds):
        with open(log, "a") as f:
            f.write(f"{path} {seconds}\n")
        if path == "/bad":
            raise adapters.FrameError
        return [None if path == "/gap" and s > 60 else bytes([0 if path == "/dark" or (path == "/later" and s > 60) else 90] * 1024) for s in seconds]

    def calls():
        import os

        lines = open(log).read().splitlines() if os.path.exists(log) else []
        open(log, "w").close()
        return sorted(lines)

    files = [("/a", 0, 100.0, False), ("/dark", 0, 100.0, False), ("/later", 0, 100.0, False), ("/bad", 0, 50.0, False), ("/gap", 0, 80.0, False), ("/pic", 0, 0.0, True), ("/err", 4, 9.0, False), ("/none", 0, None, False)]
    c = spark.createDataFrame(files, "path string, flags int, duration_s double, is_image boolean")
    none = spark.createDataFrame([], "path string, at_us long, frame binary, phash long")
    one, got = adapters.gather_missing(c, none, decode, ScanConfig(positions=1))
    assert calls() == ["/a [50.0]", "/bad [25.0]", "/dark [50.0]", "/gap [40.0]", "/later [50.0]", "/pic [0.0]"]
    assert {r.path: r.flags for r in one.collect()} == {"/a": 0, "/dark": 16, "/later": 0, "/bad": 4, "/gap": 0, "/pic": 0, "/err": 4, "/none": 0}
    assert sorted((r.path, r.at_us, r.phash is not None) for r in got.collect()) == [("/a", 50_000_000, True), ("/dark", 50_000_000, True), ("/gap", 40_000_000, True), ("/later", 50_000_000, True), ("/pic", 0, True)]
    assert calls() == []  # results are read, not decoded again
    two, more = adapters.gather_missing(one, got, decode, ScanConfig(positions=3))
    assert calls() == ["/a [25.0, 75.0]", "/dark [25.0, 75.0]", "/gap [20.0, 60.0]", "/later [25.0, 75.0]"]
    assert {r.path: r.flags for r in two.collect()}["/later"] == 0 and more.count() == 13
    same, _ = adapters.gather_missing(two, more, decode, ScanConfig(positions=3))
    assert calls() == [] and same.count() == 8
    adapters.gather_missing(same, more, decode, ScanConfig(positions=1, max_sampling_s=40.0, retry_errors=True))
    assert calls() == ["/a [20.0]", "/bad [20.0]", "/dark [20.0]", "/err [4.5]", "/later [20.0]"]  # /gap has that place


def test_any_position_can_reject(spark):
    """The quick gate tests every position: one that is over 32 bits rejects, one that lacks a hash is passed over."""
    base = {"lo": 0, "hi": 0, "duration_s": 100.0, "size": 1, "width": 1, "height": 1, "folder": "/m", "is_image": False}
    far = (1 << 33) - 1
    hashes = {1: [0, 0, 0], 2: [0, 0, far], 3: [0, None, 3], 4: [far, 0, 0], 5: [0, 0], 6: None}
    rows = [{"id": i, "path": f"/m/{i}", "file_id": i, "hashes": h, "frames": [[7] * 64] * 3, **base} for i, h in hashes.items()]
    df = spark.createDataFrame(rows, "id long, path string, file_id long, hashes array<long>, frames array<array<int>>, lo long, hi long, duration_s double, size long, width int, height int, folder string, is_image boolean")
    found = pairs.all_matches(df, ScanConfig(whole_catalog=True, positions=3))
    got = {(r.a.id, r.b.id) for r in found.select("a", "b").collect()}
    near = lambda x, y: all(p is None or q is None or (p ^ q).bit_count() <= 32 for p, q in (zip(x, y) if x and y and len(x) == len(y) else [((x or [None])[0], (y or [None])[0])]))
    assert got == {(i, j) for i in hashes for j in hashes if i < j and near(hashes[i], hashes[j])}
    assert (1, 2) not in got
    assert (1, 3) in got and (1, 4) not in got and (1, 5) in got and (1, 6) in got


def test_mirrored_hashes_are_made_of_frames(spark):
    """A video and its mirror image are found by hashes with flipped, though the caller brings no mirrored hashes."""
    from kinframe.functions.phash import hash_frames

    rnd = np.random.default_rng(8)
    bits = lambda x, y: int(np.bitwise_count(hash_frames(np.stack([x.ravel(), y.ravel()])).view(np.uint64)[:1] ^ hash_frames(np.stack([x.ravel(), y.ravel()])).view(np.uint64)[1:])[0])
    made = (np.kron(rnd.integers(0, 256, (8, 8)), np.ones((4, 4))).astype(np.uint8) for _ in range(200))
    a = [f for f in made if 10 < bits(f, f[:, ::-1]) <= 32][:2]  # the quick gate tests the plain hashes
    rows = [(1, a), (2, [f[:, ::-1] for f in a]), (3, [np.roll(f, 9, axis=0) for f in a])]
    made = [(i, [int(h) for h in hash_frames(np.stack([f.ravel() for f in fs]))], [f.tobytes() for f in fs], False) for i, fs in rows]
    x = catalog(spark, spark.createDataFrame(made, "id long, hashes array<long>, frames array<binary>, is_image boolean"))
    x = x.withColumns({"duration_s": F.lit(10.0)})
    told = lambda c: {(r.a.id, r.b.id): r.flipped for r in pairs.all_matches(x, c).collect()}
    c = {"whole_catalog": True, "positions": 2, "percent": 90.0, "use_phash": True}
    assert told(ScanConfig(**c)) == {} and told(ScanConfig(**c, flipped=True)) == {(1, 2): True}
