"""What holds queries up on larger tables: how work is dealt out, and that bounds lose nothing."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.operators import blocks


def frames(n, size, seed=5):
    """Frames about a level, of which the last ones are like the first, some just within a mean difference of 0.04 and some just over it."""
    rng = np.random.default_rng(seed)
    out = np.clip(rng.normal(127, 16, (n, size)), 0, 255).astype(np.uint8)
    for k in range(n // 4):
        moved = out[k].astype(int) + rng.choice([-1, 1], size) * (10 + k % 2)  # 10 or 11, about the limit of 10.24
        out[-1 - k] = np.clip(moved, 0, 255)
    return out


@pytest.mark.parametrize(("size", "positions"), [(64, 1), (256, 4), (1024, 1)])
def test_filter_loses_nothing(size, positions):
    f = frames(200, size)
    a, b = f[:120], f[120:]
    by = blocks._filter(a, b, 0.04)
    exact = np.abs(a[:, None].astype(int) - b[None]).mean(axis=2) / 256
    p, q, d = blocks._near(a, b, positions, by)
    assert len(p) < exact.size / 8 and np.abs(d - exact[p, q]).max() < 1e-12
    assert set(zip(*np.nonzero(exact <= 0.04))) <= set(zip(p.tolist(), q.tolist()))
    assert 0 < (exact <= 0.04).sum() < (exact <= 0.044).sum()


def test_sums_are_exact():
    rng = np.random.default_rng(6)
    for width, most in ((3, 255), (300, 255), (70, 4080), (5, 100_000)):
        a, b = (rng.integers(0, most + 1, (n, width)) for n in (13, 5000))
        assert (blocks._sums(a, b, most) == np.abs(a[:, None] - b[None]).sum(axis=2)).all()


def test_one_cell_is_many_tasks(spark, monkeypatch):
    """Frames that all lie in one cell are compared by more than one task."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rows = [(i, bytes(np.full(64, 100 + i % 2, dtype=np.uint8))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, frame binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = blocks.frame_matches(df, ScanConfig(), by_duration=False, by_kind=False, limit=0.02).withColumn("task", F.spark_partition_id())
        n = {r.task: r.n for r in found.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(n.values()) == 400 * 399 // 2 and len(n) == 4 and max(n.values()) < sum(n.values()) / 2


def test_rounding_of_mean_differences(spark):
    """flipped_pairs rounds half up without decimals: the same for every sum that a frame of 64 pixels can have."""
    d = F.col("id") / 64 / 256.0
    x = spark.range(16385).select(F.round(d, 6).alias("a"), (F.floor(d * 1e6 + 0.5) / 1e6).alias("b"))
    assert x.where("a <> b").count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_codes_meet_without_a_broadcast(spark, monkeypatch, whole):
    """Keys of codes are far more than Spark thinks, so neither way of bringing them together may go through the driver; both are exact."""
    from kinframe.operators import pairs

    monkeypatch.setattr(blocks, "CODES", (16, 16))
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63, 60, dtype=np.int64)
    h = np.concatenate([h, h ^ np.int64(5), h[:20] ^ np.int64(0x7001)]).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(h)] + [(999, None)], "id long, h long")
    want = {(i, j): (x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + 2**64).bit_count() for (i, x), (j, y) in itertools.combinations(enumerate(h), 2)}
    want = {k: v for k, v in want.items() if v <= 4}
    monkeypatch.setattr(pairs, "WHOLE_COST", 0.0)
    found = pairs.near_codes(df, df, 4, pairs.index_plan(4, 140), F.col("a.id") < F.col("b.id"), 140 if whole else None)
    got = found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "distance").collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want) > 60
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    other = df.where("id < 60")
    both = pairs.near_codes(other, df, 4, pairs.index_plan(4, 140), F.col("a.id") != F.col("b.id"), 140 if whole else None)
    assert {(r.a.id, r.b.id) for r in both.collect()} == {p for k in want for p in (k, k[::-1]) if p[0] < 60}


def test_gates_are_counted_without_pairs(spark, monkeypatch):
    """The same counts as of pairs that are made, with unknown sizes, hashes and links too; no join of rows with rows is planned."""
    from kinframe.operators import diagnostics, pairs

    monkeypatch.setattr(blocks, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 1 << 32)), int(rng.integers(0, 1 << 32)) if i % 9 else None, None if i % 31 == 0 else float(rng.integers(30, 90)), int(rng.integers(1, 99)) if i % 7 else None, int(rng.choice([0, 640, 1280, 3840])), 480, "/m", i // 2 if i % 5 else None, i % 11 == 0, "/m/x") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, lo long, hi long, duration_s double, size long, width int, height int, folder string, file_id long, is_image boolean, path string").repartition(3)
    for within, c in ((ScanConfig(duration_percent=30.0), ScanConfig(size_percent=40.0, resolution_gate=True, skip_hard_links=True)), (ScanConfig(duration_percent=0.0, duration_max_s=9.0), ScanConfig(duration_percent=5.0, duration_min_s=2.0))):
        want = diagnostics.gate_counters(pairs.duration_pairs(df.where("NOT is_image"), within, pairs.PAIR_COLUMNS), c).first().asDict()
        assert diagnostics.gate_counters_within(df, within, c).first().asDict() == want and want["pairs"] > want["after_hard_link"] > 0
    assert set(diagnostics.gate_counters_within(df.limit(0), within, c).first().asDict().values()) == {0}


def test_one_key_is_many_tasks(spark, monkeypatch):
    """All pairs of a key, each once, by more than one task; rows without a key meet nothing."""
    from kinframe.operators import pairs

    monkeypatch.setattr(pairs, "KEY_BLOCK", 8)
    df = spark.createDataFrame([((i * 37) % 1009, None if i > 140 else i % 10 // 9) for i in range(150)], "id long, label int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = pairs.keyed_pairs(df, ["label"], []).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    label = {r.id: r.label for r in df.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(label), 2) if label[a] == label[b] is not None}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert len({r.task for r in got if label[r.a] == 0}) == 4


def test_bundle_parts_are_packed(spark, tmp_path):
    """Results and keys are deflated, pictures stay as they come and are found again."""
    import zipfile

    from kinframe.sources import bundle

    x = spark.range(300).select((F.col("id") % 7).alias("group_id"), F.format_string("/media/some/folder/%04d.mp4", "id").alias("path"), F.col("id").alias("size"), F.lit(97.0).alias("similarity"), F.lit(False).alias("is_image"))
    thumbs = x.select(F.col("path").alias("key"), F.concat(F.lit("picture "), (F.col("size") % 5).cast("string")).cast("binary").alias("picture"))
    bundle.save_bundle(x, thumbs, str(tmp_path / "b"), 2)
    kinds, plain, packed = set(), 0, 0
    for part in (tmp_path / "b").glob("part-*.zip"):
        for i in zipfile.ZipFile(part).infolist():
            kinds.add((i.filename, i.compress_type))
            plain, packed = plain + i.file_size, packed + i.compress_size
    assert kinds == {("scan.json", zipfile.ZIP_DEFLATED), ("thumbs.idx", zipfile.ZIP_DEFLATED), ("thumbs.pack", zipfile.ZIP_STORED)} and packed < plain / 4
    items, back = bundle.load_bundle(spark, str(tmp_path / "b"))
    assert items.count() == 300 and {(r.key, bytes(r.picture)) for r in back.collect()} == {(r.key, bytes(r.picture)) for r in thumbs.collect()}
