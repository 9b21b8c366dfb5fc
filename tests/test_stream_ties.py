"""Streamed upserts: rows of one key and version."""

from pyspark.sql import functions as F

from kinframe.streaming import catalog_stream as S


def test_ties_are_settled_by_all_columns(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 3), ("a", 2, 9), ("a", 2, None), ("b", 1, 1), ("b", 1, 1), (None, 1, 4)]
    schema = "path string, version int, size int"
    for k, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{k}")
        S.upsert_stream(changes, f"{tmp_path}/out{k}", f"{tmp_path}/check{k}").awaitTermination()
        got = S.latest(spark.read.parquet(f"{tmp_path}/out{k}").select("path", "version", "size"))
        assert sorted((r.path or "", r.version, r["size"]) for r in got.collect()) == [("", 1, 4), ("a", 2, 9), ("b", 1, 1)]
        assert got.where(F.col("path").isNull()).count() == 1
