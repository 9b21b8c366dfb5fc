"""The clip phase of the whole flow: who takes part, the visual gate, the union with the groups."""

import random

import pytest

from kinframe.config import ScanConfig
from kinframe.plans.engine import MediaEngine

CONFIG = {"whole_catalog": True, "partial_clips": True}
SCHEMA = "id long, path string, folder string, size long, file_size long, duration_s double, width int, height int, lo long, hi long, frame array<int>, file_id long, is_image boolean, flags int, on_disk boolean, fp array<long>"


def catalog(spark):
    """1 and 2 are duplicates; 3 holds 4; 5 and 6 are silent; 7 is like 4, but flagged silent; 8 is cut from 1, which is grouped."""
    rng = random.Random(5)
    fp = lambda n: [rng.getrandbits(32) for _ in range(n)]
    a, b = fp(100), fp(100)
    prints = {1: a, 2: a, 3: b, 4: b[20:40], 5: [0] * 100, 6: [0] * 20, 7: b[20:40], 8: a[10:40]}
    long = {1: 100.0, 2: 100.0, 3: 300.0, 4: 40.0, 5: 280.0, 6: 41.0, 7: 42.0, 8: 37.0}
    rows = []
    for i in prints:
        frame = [9 + 200 * (i > 2)] * 64 if i < 3 else [(i * 31 * (k + 1) + 97 * k * k) % 200 + 40 for k in range(64)]
        rows.append((i, f"/m/{i}.mp4", "/m", 1000 + i, 1000 + i, long[i], 640, 480, i * 77777, i * 55555, [max(x, 60) for x in frame], i, False, 128 if i == 7 else 0, True, prints[i]))
    return spark.createDataFrame(rows, SCHEMA)


def found(items):
    return sorted((r.group_id, r.id, r.is_clip, r.offset_s, round(r.similarity, 3)) for r in items.collect())


GROUP = [(1, 1, False, 0, 100.0), (1, 2, False, 0, 100.0)]
CLIP = [(3, 3, False, 0, 100.0), (3, 4, True, 20, 100.0)]


def test_union_and_eligibility(spark):
    c = catalog(spark)
    assert found(MediaEngine(spark, ScanConfig(**CONFIG)).run(c)) == GROUP + CLIP
    assert found(MediaEngine(spark, ScanConfig(whole_catalog=True)).run(c)) == GROUP
    assert found(MediaEngine(spark, ScanConfig(**CONFIG)).run(c.drop("fp"))) == GROUP


@pytest.mark.parametrize("other, stays", [([5] * 64, True), ([205] * 64, False), (None, True)])
def test_visual_gate(spark, other, stays):
    frames = [(4, t, [5] * 64) for t in (10.0, 20.0, 30.0)] + [(3, 20 + t, other) for t in (10.0, 20.0, 30.0)]
    engine = MediaEngine(spark, ScanConfig(**CONFIG, clip_visual_gate=True))
    frames = spark.createDataFrame(frames, "id long, at_s double, frame array<int>")
    assert found(engine.run(catalog(spark), frames)) == GROUP + (CLIP if stays else [])
    with pytest.raises(ValueError, match="frames"):
        engine.run(catalog(spark))
