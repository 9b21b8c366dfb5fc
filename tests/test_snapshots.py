"""Catalog snapshots: versions that are whole or absent, and damaged parts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from kinframe.operators import catalog as C


def rows(df):
    return sorted((r.path, r.version) for r in df.collect())


def test_a_failed_write_keeps_the_catalog(spark, tmp_path):
    at = f"file://{tmp_path}/catalog"
    with pytest.raises(FileNotFoundError):
        C.load(spark, at)
    one = spark.createDataFrame([(f"/m/{i}", i) for i in range(50)], "path string, version int").repartition(4)
    first = C.save(one, at)
    bad = one.withColumn("version", F.when(F.col("version") == 17, F.raise_error(F.lit("stopped"))).otherwise(F.col("version")).cast("int"))
    with pytest.raises(Exception, match="stopped"):
        C.save(bad, at)
    assert rows(C.load(spark, at)) == rows(one) and C.versions(spark, at) == [first]
    # a version may be written from the one before it; the failed folder goes then
    second = C.save(C.load(spark, at).where("version < 10"), at)
    assert C.load(spark, at).count() == 10 and C.load(spark, at, first).count() == 50
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/catalog/*")) == sorted(f"{k}-{v}" for k in ("manifest", "version") for v in (first, second))
    third = C.save(one.limit(0), at)
    assert C.versions(spark, at) == [second, third] and C.load(spark, at).count() == 0 and C.load(spark, at).columns == ["path", "version"]


def test_damaged_parts_are_listed_and_the_rest_loads(spark, tmp_path):
    at = f"file://{tmp_path}/catalog"
    C.save(spark.createDataFrame([(f"/m/{i}", i) for i in range(400)], "path string, version int").repartition(4), at)
    assert C.damaged(spark, at).count() == 0
    parts = sorted(glob.glob(f"{tmp_path}/catalog/version-*/*.parquet"))
    kept = {r.path for r in C.load(spark, at).where(~F.col("_metadata.file_path").endswith(parts[0].rsplit("/", 1)[1])).collect()}
    with open(parts[0], "r+b") as f:  # the footer is gone
        f.truncate(40)
    for crc in glob.glob(f"{tmp_path}/catalog/version-*/.*.crc"):
        os.remove(crc)
    assert [r.file for r in C.damaged(spark, at).collect()] == [parts[0].rsplit("/", 1)[1]]
    assert {r.path for r in C.load(spark, at).collect()} == kept and 0 < len(kept) < 400
