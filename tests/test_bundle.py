"""Bundles: what is written is read back, whole or not at all."""

import glob
import json
import os
import zipfile

import pytest
import xxhash
from pyspark.sql import functions as F

from kinframe.sources import bundle as B

ITEMS = "group_id long, path string, size long, similarity double, is_image boolean, key string"
THUMBS = "key string, picture binary"


def data(spark, n=60):
    items = spark.createDataFrame([(i // 3, f"/m/a,b]}}\"\n{i}.mp4", i, 90.5, i % 2 == 0, "clash") for i in range(n)], ITEMS)
    thumbs = spark.createDataFrame([(f"k{i:03d}", bytes([i % 7]) * (1000 + i % 7)) for i in range(n)], THUMBS)
    return items, thumbs


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, tmp_path, parts):
    items, thumbs = data(spark)
    at = f"{tmp_path}/b"
    B.save_bundle(items, thumbs, at, parts)
    got, pictures = B.load_bundle(spark, at)
    plain = lambda df: sorted((r.group_id, r.path, r["size"], r.similarity, r.is_image) for r in df.collect())
    assert plain(got) == plain(items)
    assert {r.key: bytes(r.picture) for r in pictures.collect()} == {r.key: bytes(r.picture) for r in thumbs.collect()}
    assert len(glob.glob(f"{at}/part-*.zip")) <= parts


def test_a_part_is_a_plain_zip_with_each_picture_once(spark, tmp_path):
    items, thumbs = data(spark)
    B.save_bundle(items, thumbs, f"{tmp_path}/b", 1)
    (part,) = glob.glob(f"{tmp_path}/b/part-*.zip")
    with zipfile.ZipFile(part) as z:
        assert z.testzip() is None
        assert z.namelist() == list(B.ENTRIES)
        doc = json.loads(z.read("scan.json"))
        assert doc["version"] == 1 and len(doc["items"]) == 60
        assert len(z.read("thumbs.pack")) == sum(1000 + k for k in range(7))
        assert len(z.read("thumbs.idx").splitlines()) == 60


def test_a_failed_write_leaves_the_bundle_before(spark, tmp_path):
    items, thumbs = data(spark)
    at = f"{tmp_path}/b"
    B.save_bundle(items, thumbs, at, 3)
    before = sorted(os.listdir(at))
    broken = thumbs.withColumn("picture", F.when(F.col("key") == "k010", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("picture")))
    with pytest.raises(Exception, match="broken"):
        B.save_bundle(items.where("size < 10"), broken, at, 3)
    assert B.load_bundle(spark, at)[0].count() == 60
    assert set(before) <= set(os.listdir(at))
    B.save_bundle(items.where("size < 10"), thumbs, at, 2)
    assert B.load_bundle(spark, at)[0].count() == 10
    names = json.load(open(f"{at}/{B.MANIFEST}"))["parts"]
    assert sorted(os.path.basename(p) for p in glob.glob(f"{at}/part-*")) == names


def test_odd_rows(spark, tmp_path):
    """Null keys, null and empty pictures are left out; of a repeated key one picture stays; empty tables make an empty bundle."""
    items, _ = data(spark, 3)
    thumbs = spark.createDataFrame([(None, b"x"), ("a", None), ("b", b""), ("c", b"1"), ("c", b"1"), ("c", b"2"), ("d", b"1")], THUMBS)
    B.save_bundle(items, thumbs, f"{tmp_path}/b", 2)
    got = {r.key: bytes(r.picture) for r in B.load_bundle(spark, f"{tmp_path}/b")[1].collect()}
    assert set(got) == {"c", "d"} and got["d"] == b"1" and got["c"] in (b"1", b"2")
    B.save_bundle(items.limit(0), thumbs.limit(0), f"{tmp_path}/e", 2)
    a, b = B.load_bundle(spark, f"{tmp_path}/e")
    assert a.count() == b.count() == 0
    with pytest.raises(Exception, match="no bundle"):
        B.load_bundle(spark, f"{tmp_path}/none")[0].count()


def test_keys_places_and_the_retry_rule(spark):
    row = spark.createDataFrame([("/a/\u00e4.mp4", 12.345)], "p string, t double")
    key = row.select(B.thumb_key(F.col("p"), F.col("t"), F.lit(100), F.lit(90)).alias("k")).first().k
    assert key == xxhash.xxh64_hexdigest("/a/\u00e4.mp4|12.35|100|90".encode("utf-16-le")) or key == xxhash.xxh64_hexdigest("/a/\u00e4.mp4|12.34|100|90".encode("utf-16-le"))
    assert B.thumb_places(3) == [0.25, 0.5, 0.75]
    cases = [(0, False, 100, True), (None, None, None, True), (1, True, 100, True), (2, True, 100, False), (3, False, 60, True), (3, False, 100, False), (3, False, 0, False)]
    df = spark.createDataFrame(cases, "n int, p boolean, w int, want boolean")
    assert df.where(B.needs_thumbs(F.col("n"), F.col("p"), F.col("w"), 100) != F.col("want")).count() == 0
