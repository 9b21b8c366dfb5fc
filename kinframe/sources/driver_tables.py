"""A media catalog derived from the driver's tables, by integer formulas that Spark and DuckDB evaluate alike.

Items come from ``embeddings`` (64 floats: an 8 x 8 frame and the input of a median-split hash). Every fifth one
has a clone: up to two flipped hash bits, pixels off by up to 2, a second longer. Ranking tables come from
``lineitem`` (group: order), catalogs from ``part``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a clone's id is more than its source's: beyond any id of the tables.
CLONE = 1 << 40
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attributes(df: DataFrame) -> DataFrame:
    """duration_s, size, width, height, fps, bitrate_kbps, path, folder, file_id of an item (id, src, label)."""
    src, clone = F.col("src"), (F.col("id") != F.col("src")).cast("int")
    wide = F.element_at(F.array(*(F.lit(x) for x in (640, 1280, 1920, 3840))), (src % 4 + 1).cast("int"))
    high = F.element_at(F.array(*(F.lit(x) for x in (480, 720, 1080, 2160))), (src % 4 + 1).cast("int"))
    return df.withColumns(
        {
            "duration_s": (30 + (src * 7919) % 3570 + clone).cast("double"),
            "size": 1_000_000 + (src * 104_729) % 500_000 * 1000 + clone * 1024,
            "width": F.when((clone == 1) & (src % 3 == 0), (wide / 2).cast("int")).otherwise(wide),
            "height": F.when((clone == 1) & (src % 3 == 0), (high / 2).cast("int")).otherwise(high),
            "fps": (24 + src % 3 * 3).cast("double"),
            "bitrate_kbps": 500 + (F.col("id") * 37) % 8000,
            "folder": F.concat(F.lit("/media/f"), F.col("label").cast("string"), F.when(clone == 1, "/copies").otherwise("")),
            "file_id": F.when((clone == 1) & (src % 4 == 0), src).otherwise(F.col("id")),
            "is_image": src % 7 == 0,
        }
    ).withColumn("path", F.concat("folder", F.lit("/"), F.col("id").cast("string"), F.when(F.col("is_image"), ".jpg").otherwise(".mp4")))


def _features(vectors: pd.Series) -> pd.DataFrame:
    """Hash halves and mini-frame of 64-value vectors; a kernel of its own, so that no plan computes them twice over."""
    v = np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.zeros((0, 64))
    ordered = np.sort(v, axis=1)
    bits = v > ((ordered[:, 31] + ordered[:, 32]) / 2)[:, None]
    weight = np.int64(1) << np.arange(32, dtype=np.int64)
    frame = np.floor((np.clip(v, -1.0, 1.0) + 1) * 127.5).astype(np.int32)
    return pd.DataFrame({"lo": (bits[:, :32] * weight).sum(axis=1), "hi": (bits[:, 32:] * weight).sum(axis=1), "frame": list(frame)})


def base_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, label, lo, hi (hash halves) and frame (64 ints) of each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("src"), "label", F.pandas_udf(_features, "struct<lo:long,hi:long,frame:array<int>>")("embedding").alias("f"))
    return e.select("id", "src", "label", "f.lo", "f.hi", "f.frame")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: base items and their clones with all attributes."""
    base = base_items(spark, sf_dir)
    src = F.col("src")
    one = F.lit(1).cast("long")
    clones = base.where(src % 5 == 0).select(
        (src + CLONE).alias("id"),
        "src",
        "label",
        F.col("lo").bitwiseXOR(F.call_function("shiftleft", one, (src % 31).cast("int"))).alias("lo"),
        F.when(src % 2 == 0, F.col("hi").bitwiseXOR(F.call_function("shiftleft", one, (src * 7 % 31).cast("int")))).otherwise(F.col("hi")).alias("hi"),
        F.transform("frame", lambda x, i: F.greatest(F.lit(0), F.least(F.lit(255), x + ((i + src) % 5 - 2).cast("int")))).alias("frame"),
    )
    return _attributes(base.unionByName(clones))


def position_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of four positions: each four base items in a row are one, every third has a clone with a bit of each hash flipped and pixels off by up to 2."""
    base = base_items(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 4))
    four = base.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "lo", "hi", "frame"))).alias("v")).where(F.size("v") == 4)
    whole = lambda lo, hi: F.shiftleft(hi, 32).bitwiseOR(lo)
    entry = four.select("g", F.transform("v", lambda x: whole(x["lo"], x["hi"])).alias("hashes"), F.transform("v", lambda x: x["frame"]).alias("frames"))
    one = F.lit(1).cast("long")
    moved = lambda v, j: F.transform(v, lambda x, i: F.greatest(F.lit(0), F.least(F.lit(255), x + ((i + j + 2) % 5 - 2).cast("int"))))
    clone = entry.where("g % 3 = 0").select((F.col("g") + CLONE).alias("g"), F.transform("hashes", lambda x, j: x.bitwiseXOR(F.call_function("shiftleft", one, ((j + 1) * 5).cast("int")))).alias("hashes"), F.transform("frames", moved).alias("frames"))
    same = {"duration_s": F.lit(100.0), "size": F.lit(1_000_000), "width": F.lit(640), "height": F.lit(480), "folder": F.lit("/media"), "is_image": F.lit(False)}
    out = entry.unionByName(clone).select(F.col("g").cast("long").alias("id"), "hashes", "frames").withColumns(same)
    return out.withColumns({"file_id": F.col("id"), "path": F.concat(F.lit("/media/"), F.col("id").cast("string"), F.lit(".mp4"))})


ITEMS_SQL = f"""
e AS (SELECT vec_id AS id, vec_id AS src, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
med AS (SELECT *, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS med FROM e),
base AS (SELECT id, src, label,
  CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN v[i + 1] > med THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS lo,
  CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN v[i + 33] > med THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS hi,
  list_transform(v, lambda x: CAST(floor((greatest(least(x, 1.0), -1.0) + 1) * 127.5) AS INTEGER)) AS frame FROM med),
clones AS (SELECT src + {CLONE} AS id, src, label, xor(lo, CAST(1 AS BIGINT) << CAST(src % 31 AS INTEGER)) AS lo,
  CASE WHEN src % 2 = 0 THEN xor(hi, CAST(1 AS BIGINT) << CAST(src * 7 % 31 AS INTEGER)) ELSE hi END AS hi,
  list_transform(range(0, 64), lambda i: CAST(greatest(0, least(255, frame[i + 1] + (i + src) % 5 - 2)) AS INTEGER)) AS frame FROM base WHERE src % 5 = 0),
u AS (SELECT id, src, label, lo, hi, frame FROM base UNION ALL SELECT id, src, label, lo, hi, frame FROM clones),
w AS (SELECT *, CAST(id <> src AS INTEGER) AS c FROM u),
x AS (SELECT *, CAST(30 + (src * 7919) % 3570 + c AS DOUBLE) AS duration_s, 1000000 + (src * 104729) % 500000 * 1000 + c * 1024 AS size,
  CAST(CASE WHEN c = 1 AND src % 3 = 0 THEN [640, 1280, 1920, 3840][CAST(src % 4 + 1 AS INTEGER)] // 2 ELSE [640, 1280, 1920, 3840][CAST(src % 4 + 1 AS INTEGER)] END AS INTEGER) AS width,
  CAST(CASE WHEN c = 1 AND src % 3 = 0 THEN [480, 720, 1080, 2160][CAST(src % 4 + 1 AS INTEGER)] // 2 ELSE [480, 720, 1080, 2160][CAST(src % 4 + 1 AS INTEGER)] END AS INTEGER) AS height,
  CAST(24 + src % 3 * 3 AS DOUBLE) AS fps, 500 + (id * 37) % 8000 AS bitrate_kbps,
  '/media/f' || label || CASE WHEN c = 1 THEN '/copies' ELSE '' END AS folder, CASE WHEN c = 1 AND src % 4 = 0 THEN src ELSE id END AS file_id, src % 7 = 0 AS is_image FROM w),
items AS (SELECT * EXCLUDE (c), folder || '/' || id || CASE WHEN is_image THEN '.jpg' ELSE '.mp4' END AS path FROM x)
"""


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows for ranking and reports: group_id is an order, items are its lines."""
    n = table(spark, sf_dir, "lineitem")
    key, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return n.select(
        key.alias("group_id"),
        F.concat_ws("-", key.cast("string"), F.col("l_linenumber").cast("string"), part.cast("string"), supp.cast("string"), cents.cast("string"), F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("path"),
        cents.alias("size"),
        (F.col("l_quantity").cast("int") * 10).alias("duration_s"),
        (640 + part % 4 * 640 + 480 + part % 4 * 240).cast("int").alias("frame_size"),
        (24 + part % 3 * 3).cast("int").alias("fps"),
        (500 + part * 37 % 8000).cast("int").alias("bitrate_kbps"),
        (64 + supp % 5 * 64).cast("int").alias("audio_kbps"),
        (44100 + supp % 2 * 3900).cast("int").alias("audio_rate"),
        (part % 5).cast("int").alias("hdr_rank"),
        (100 - F.round(F.col("l_discount") * 100).cast("int")).alias("similarity"),
        (key % 11 == 0).alias("is_image"),
        F.col("l_shipdate").alias("date_created"),
    )


RANKED_SQL = """
ranked AS (SELECT l_orderkey AS group_id,
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), strftime(l_shipdate, '%Y%m%d'), CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR)) AS path,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS size, CAST(l_quantity AS INTEGER) * 10 AS duration_s,
  CAST(640 + l_partkey % 4 * 640 + 480 + l_partkey % 4 * 240 AS INTEGER) AS frame_size, CAST(24 + l_partkey % 3 * 3 AS INTEGER) AS fps,
  CAST(500 + l_partkey * 37 % 8000 AS INTEGER) AS bitrate_kbps, CAST(64 + l_suppkey % 5 * 64 AS INTEGER) AS audio_kbps,
  CAST(44100 + l_suppkey % 2 * 3900 AS INTEGER) AS audio_rate, CAST(l_partkey % 5 AS INTEGER) AS hdr_rank,
  100 - CAST(round(l_discount * 100) AS INTEGER) AS similarity, l_orderkey % 11 = 0 AS is_image, l_shipdate AS date_created FROM lineitem)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows from ``part``: path, folder, file_size, flags, frames_ok, on_disk, modified."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    folder = F.concat(F.lit("/media/lib"), (k % 7).cast("string"), F.lit("/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    ext = F.element_at(F.array(*(F.lit(x) for x in (".mp4", ".JPG", ".mkv", ".txt", ".png"))), (k % 5 + 1).cast("int"))
    return p.select(
        k.alias("id"),
        F.concat(folder, F.lit("/item"), k.cast("string"), ext).alias("path"),
        folder.alias("folder"),
        (k * 7_919_317 % 3_000_000_000).alias("file_size"),
        F.when(k % 13 == 0, 2).when(k % 17 == 0, 16).when(k % 19 == 0, 4).when(k % 23 == 0, 8).when(k % 29 == 0, 256).otherwise(0).alias("flags"),
        (k % 5).isin(1, 4).alias("is_image"),
        (k % 31 != 0).alias("on_disk"),
        (k % 37).cast("int").alias("version"),
    )


CATALOG_SQL = """
catalog AS (SELECT p_partkey AS id, '/media/lib' || (p_partkey % 7) || '/' || replace(p_brand, '#', '_') || '/item' || p_partkey || ['.mp4', '.JPG', '.mkv', '.txt', '.png'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS path,
  '/media/lib' || (p_partkey % 7) || '/' || replace(p_brand, '#', '_') AS folder, p_partkey * 7919317 % 3000000000 AS file_size,
  CASE WHEN p_partkey % 13 = 0 THEN 2 WHEN p_partkey % 17 = 0 THEN 16 WHEN p_partkey % 19 = 0 THEN 4 WHEN p_partkey % 23 = 0 THEN 8 WHEN p_partkey % 29 = 0 THEN 256 ELSE 0 END AS flags,
  p_partkey % 5 IN (1, 4) AS is_image, p_partkey % 31 <> 0 AS on_disk, CAST(p_partkey % 37 AS INTEGER) AS version FROM part)
"""
