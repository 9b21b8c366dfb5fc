"""Scalar functions, settings and sequential kernels on hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.config import ScanConfig, preset
from kinframe.functions import audio, phash
from kinframe.functions import kernels as K
from kinframe.operators import catalog as C
from kinframe.operators import clips, filters, grouping, pairs, results
from kinframe.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def frame(values):
    return F.array(*(F.lit(int(v)) for v in values))


def test_pixel_metrics(spark):
    a, b = frame([0, 100, 255, 50]), frame([10, 90, 255, 50])
    assert one(spark, K.pixel_difference(a, b)) == 20 / 4 / 256
    assert abs(one(spark, K.masked_difference(a, b)) - np.float32(10) / np.float32(2) / np.float32(256)) < 1e-7
    assert np.isnan(one(spark, K.masked_difference(frame([0, 0]), frame([0, 0]))))
    assert one(spark, K.flipped(frame([1, 2, 3, 4]), 2)) == [2, 1, 4, 3]
    assert one(spark, K.is_dark(frame([0] * 8 + [99] * 2))) is True
    assert one(spark, K.is_dark(frame([0] * 7 + [99] * 3))) is False


def test_phash_matches_plain_loops():
    rng = np.random.default_rng(5)
    frames = rng.integers(0, 256, (4, 1024), dtype=np.uint8)
    got = phash.hash_frames(frames)
    assert (got == np.concatenate([phash.hash_frames(frames[i : i + 1]) for i in range(4)])).all()
    ones = [bin(int(h) & (1 << 64) - 1).count("1") for h in got]
    assert all(28 <= n <= 32 for n in ones)
    x = np.arange(32)
    basis = np.stack([np.sqrt(2 / 32) * np.cos((2 * x + 1) * u * np.pi / 64) for u in range(1, 9)])
    for f, h in zip(frames.reshape(-1, 32, 32).astype(float), got):
        ac = (basis @ f @ basis.T).ravel()  # v outer, u inner
        want = sum(1 << i for i in range(64) if ac[i] > np.median(ac))
        assert bin(want ^ (int(h) & (1 << 64) - 1)).count("1") <= 1
    with pytest.raises(ValueError):
        phash.hash_frames(frames[:, :100])


def test_thresholds():
    assert [ScanConfig(percent=p).max_bits for p in (90, 95, 96, 97, 98, 99)] == [6, 3, 2, 1, 1, 0]
    assert ScanConfig(positions=3).position_list() == [0.25, 0.5, 0.75]
    assert ScanConfig(percent=200).validate().percent == 100
    assert preset("precise").use_phash and preset("precise").positions == 3
    assert ScanConfig.from_dict({"percent": 91, "unknown": 1, "include": ["/a"]}).include == ("/a",)


@pytest.mark.parametrize(("args", "want"), [((100.0, 20, 0, 0), 20.0), ((100.0, 1, 5, 0), 5.0), ((100.0, 50, 0, 30), 30.0), ((100.0, 0, 4, 9), 9.0)])
def test_duration_tolerance(spark, args, want):
    d, p, lo, hi = args
    assert one(spark, K.duration_tolerance(F.lit(d), p, lo, hi)) == want


def test_strings(spark):
    assert one(spark, K.human_bytes(F.lit(0))) == "0 B"
    assert one(spark, K.human_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, K.human_duration(F.lit(90061))) == "1d, 1h"
    assert one(spark, K.human_duration(F.lit(59))) == "59s"
    assert one(spark, K.csv_field(F.lit('a,"b'))) == '"a,""b"'
    assert one(spark, K.size_mb(F.lit(104857599))) == 100
    assert one(spark, K.glob(F.lit("/A/b%c.MP4"), "*b%c.mp?")) is True
    assert one(spark, K.glob(F.lit("/A/bxc.MP4"), "*b%c.mp?")) is False
    with pytest.raises(ValueError):
        K.phash_match(F.lit(1), 1.5)


def test_include_and_exclude(spark):
    inside = lambda f, *r: one(spark, filters.included(F.lit(f), r))
    assert inside("/v/sub", "/v") and inside("/v", "/v/") and not inside("/videos", "/v") and not inside("/v/.git", "/v") and not inside("/v")
    out = lambda f, e: one(spark, filters.excluded(F.lit(f), (e,)))
    assert out("/a/B/c", "/A/b") and not out("/a/bc", "/a/b") and out("/x/tmp12/y", "tmp*") and not out("/x/atmp/y", "tmp*") and out("/x/q/y", "/x/*/y")


def test_sliding_window(spark):
    arr = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    long = arr(0, 0x11111111, 0xDEADBEEF, 0xCAFEBABE, 0x22222222)
    assert tuple(one(spark, clips.sliding_match(arr(0xDEADBEEF, 0xCAFEBABE), long, 0.0))) == (1.0, 2)
    # ten values leave 63 bits at 0.8, not 64
    bits = lambda n: [0xFFFFFFFF if i < n // 32 else ((1 << n % 32) - 1 if i == n // 32 else 0) for i in range(10)]
    zero = arr(*[0] * 10)
    assert one(spark, clips.sliding_match(arr(*bits(64)), zero, 0.8)) is None
    assert one(spark, clips.sliding_match(arr(*bits(63)), zero, 0.8)) is not None
    assert one(spark, clips.sliding_match(F.array().cast("array<long>"), zero, 0.0)) is None


def test_greedy_groups_and_chains():
    info = {i: {"v": v} for i, v in enumerate([0, 1, 2, 3, 10])}
    near = lambda x, y: abs(x["v"] - y["v"]) <= 1
    found = grouping.resolve(info, [(0, 1, 0.1, False), (1, 2, 0.2, True), (2, 3, 0.3, False)], near)
    # 2 is close to 1 but not to the representative 0, so it founds a group with 3
    assert found[0]["group"] == found[1]["group"] != found[2]["group"] == found[3]["group"]
    assert found[1]["difference"] == 0.1
    link = {frozenset(p) for p in [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (2, 4)]}
    parts = grouping.split_chains([0, 1, 2, 3, 4, 5], lambda i, j: frozenset((i, j)) in link)
    assert all(len(p) >= 2 for p in parts) and 5 not in sum(parts, [])


def test_components_do_not_depend_on_partitions(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (7, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    for n in (1, 5):
        got = {r.id: r.component for r in grouping.connected_components(df.repartition(n)).collect()}
        assert got == {**dict.fromkeys([*range(41), 200], 0), 100: 100, 101: 100, 103: 100}


def test_pigeonhole_equals_theta(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    hashes = base + [b ^ (1 << int(k)) ^ (1 << int(j)) for b, k, j in zip(base, rng.integers(0, 62, 60), rng.integers(0, 62, 60))]
    rows = spark.createDataFrame([(i, h & 0xFFFFFFFF, h >> 32) for i, h in enumerate(hashes)], "id long, lo long, hi long")
    pick = lambda df: sorted(tuple(r) for r in df.select(F.col("a.id"), F.col("b.id"), "distance").collect())
    want = pick(pairs.theta_pairs(rows, []).where("distance <= 3"))
    assert pick(pairs.pigeonhole_pairs(rows, 3, [])) == want and len(want) >= 60
    assert pick(pairs.lsh_pairs(rows, 2, [])) == [w for w in want if w[2] <= 2]


def test_gates(spark):
    assert one(spark, pairs.resolution_gate(F.lit(3840), F.lit(2160), F.lit(640), F.lit(480))) is False
    assert one(spark, pairs.resolution_gate(F.lit(1920), F.lit(1080), F.lit(1280), F.lit(720))) is True
    assert one(spark, pairs.resolution_gate(F.lit(0), F.lit(0), F.lit(1280), F.lit(720))) is True
    arr = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    assert one(spark, pairs.match_positions(arr(0, 0), arr(1, 3), 2)) == 1 - 1.5 / 64
    assert one(spark, pairs.match_positions(arr(0, 0), arr(1, 7), 2)) is None


def test_audio():
    assert audio.majority(np.array([], dtype=np.int64)) == 0
    assert audio.majority(np.array([1, 1, 2, 2])) == 0 and audio.majority(np.array([3, 1, 2])) == 3
    c = np.zeros((9, 12))
    c[4] = 2.5
    assert np.allclose(audio.smoothed(c)[:, 0], [0.25, 0.5, 1.0, 0.5, 0.25])
    assert audio.bits(np.zeros((1, 12)))[0] == 0
    assert (audio.normalised(np.full((1, 12), 1e-9)) == 0).all()
    t = np.arange(2 * audio.RATE) / audio.RATE
    a = audio.chroma(np.sin(2 * np.pi * 452 * t)[None, : audio.FRAME])[0]
    assert a.argmax() == 0  # A is the first note
    assert audio.fingerprint(np.zeros(100)) == []


def test_stream_fingerprint_equals_batch(spark, tmp_path):
    from kinframe.streaming.catalog_stream import fingerprint_stream

    t = np.arange(4 * audio.RATE) / audio.RATE
    pcm = (8000 * np.sin(2 * np.pi * (200 + 100 * t) * t)).astype("<i2")
    whole = audio.fingerprint(pcm)
    step = len(pcm) // 3
    rows = [("x", i, bytearray(pcm[i * step : (i + 1) * step if i < 2 else None].tobytes())) for i in range(3)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "path string, seq long, pcm binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("path string, seq long, pcm binary").parquet(str(tmp_path / "in"))
    q = fingerprint_stream(s).writeStream.format("memory").queryName("fps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.second: r.fp for r in spark.sql("SELECT * FROM fps").collect()}
    assert got == dict(enumerate(whole[: len(got)])) and len(got) == len(whole) - 1  # the last second is still open


def test_upsert_stream(spark, tmp_path):
    from kinframe.streaming.catalog_stream import latest, upsert_stream

    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 3)], "path string, version long").write.parquet(src)
    s = spark.readStream.schema("path string, version long").parquet(src)
    for _ in range(2):
        upsert_stream(s, str(tmp_path / "cat"), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("b", 7), ("c", 1)], "path string, version long").write.mode("append").parquet(src)
    rows = latest(spark.read.parquet(str(tmp_path / "cat")).drop("batch"))
    assert sorted(map(tuple, rows.collect())) == [("a", 3), ("b", 7), ("c", 1)]


def test_upsert_states(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("z", 9, 7)], "path string, size int, feature int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size int")
    got = {r.path: (r.size, r.feature, r.state) for r in C.upsert(old, new, ["size"]).collect()}
    assert got == {"a": (1, 5, "kept"), "b": (2, None, "replaced"), "c": (3, None, "new"), "z": (9, 7, "kept")}


def test_blacklist_documents(spark):
    texts = spark.createDataFrame([('{"version":1,"groups":[["a","b"],["c"]]}',)], "value string")
    assert [r.paths for r in files.blacklist(texts).collect()] == [["a", "b"], ["c"]]
    assert files.blacklist(spark.createDataFrame([('[["x"]]',), ("broken",)], "value string")).count() == 1
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "q")], "group_id long, path string")
    black = files.blacklist(texts)
    assert [r[0] for r in results.blacklisted_groups(items, black).collect()] == [1]
    left, more = results.not_a_match(items, black, [2])
    assert more.count() == 3 and left.count() == 2


def test_results_documents(spark):
    docs = spark.createDataFrame([('{"version":1,"items":[{"itemInfo":{"Path":"p","groupId":4}}]}',), ('[{"path":"q"}]',), ('[{"itemInfo":{"path":"r"}},{"x":1}]',)], "value string")
    assert sorted((r.path, r.group_id) for r in files.read_results(docs).collect()) == [("p", 4), ("q", None), ("r", None)]
    with pytest.raises(Exception, match="no valid item"):
        files.read_results(spark.createDataFrame([("[{}]",)], "value string")).collect()


def test_expression_is_checked(spark):
    items = spark.createDataFrame([(1, "a", 5), (1, "b", 9)], "group_id long, path string, size int")
    assert [r.path for r in filters.expression_filter(items, "size > 6 and path like 'b%'").collect()] == ["b"]
    for bad in ("exp(1) > 0", "size > 1; drop", "java_method('x', 'y') = 1"):
        with pytest.raises(ValueError, match="unknown|single"):
            filters.expression_filter(items, bad)


def test_listing(spark, tmp_path):
    for n in ("a.mp4", "b.TXT", "sub/c.JPG"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = files.listing(spark, [str(tmp_path)])
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.mp4", "c.JPG"]


def test_human_bytes_to_the_largest_unit(spark):
    """The reference's own cases, and the units that the query's SQL doesn't list."""
    for n, text in ((512, "512.0 B"), (1 << 20, "1.0 MB"), ((1 << 40) - (1 << 27), "1023.9 GB"), (1 << 40, "1.0 TB"), (3 << 49, "1.5 PB"), (1 << 60, "1.0 EB")):
        assert one(spark, K.human_bytes(F.lit(n))) == text
