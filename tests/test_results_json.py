"""Every group goes through JSON and back."""

from pyspark.sql import functions as F

from kinframe import queries as Q
from kinframe.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def test_all_groups_come_back(spark):
    columns = ["group_id", "path", "size", "similarity", "is_image"]
    want = D.ranked_items(spark, SF).withColumn("similarity", F.col("similarity").cast("double")).select(columns).collect()
    got = Q.queries()["results_json"](spark, SF).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
