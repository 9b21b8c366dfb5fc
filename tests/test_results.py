"""Names, exports and selections on hand-made rows."""

from pyspark.sql import functions as F

from kinframe.operators import diagnostics, ranking, results
from kinframe.sources import files


def test_destination_names(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = {r.path: r.target for r in results.destination_names(df(["/a/v.mp4", "/b/v.mp4", "/c/v_1.mp4"]), "/dest").collect()}
    assert got == {"/a/v.mp4": "/dest/v.mp4", "/b/v.mp4": "/dest/v_2.mp4", "/c/v_1.mp4": "/dest/v_1.mp4"}
    existing = spark.createDataFrame([("v.mp4",), ("v_2.mp4",), ("x",)], "name string")
    paths = [f"/{k}/v.mp4" for k in "abcd"] + ["/e/v_1.mp4", "/f/v_5.mp4", "/g/x", "/h/x", "/i/v_01.mp4"]
    got = [r.target for r in results.destination_names(df(paths), "/dest", existing).collect()]
    taken = {"/dest/v.mp4", "/dest/v_2.mp4", "/dest/x"}
    assert len(set(got)) == len(paths) and not set(got) & taken
    assert set(got) == {f"/dest/v_{k}.mp4" for k in ("1", "3", "4", "5", "6", "7", "01")} | {"/dest/x_1", "/dest/x_2"}
    assert results.destination_names(df([]), "/dest").count() == 0


def test_written_lines(spark, tmp_path):
    rows = spark.createDataFrame([(g, i, f"{g},{i}") for g in range(9) for i in range(3)], "group_id long, place int, line string").repartition(5)
    files.write_lines(rows, ["group_id", "place"], f"file://{tmp_path}/out", ("GroupId", "Place"), bom=True)
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["﻿GroupId,Place"] + [f"{g},{i}" for g in range(9) for i in range(3)]


def test_observed_counts(spark):
    df, seen = diagnostics.observed(spark.range(10), "seen", n=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    df.collect()
    assert seen.get == {"n": 10, "even": 5}


def test_custom_selection_leaves_checked_groups_alone(spark):
    rows = [(1, "a", 5), (1, "b", 5), (1, "c", 7), (2, "d", 1), (2, "e", 2)]
    more = {c: F.lit(1) for c in ranking.IDENTITY if c not in ("size", "is_image")}
    items = spark.createDataFrame(rows, "group_id long, path string, size long").withColumns({**more, "is_image": F.lit(False), "date_created": F.to_date(F.lit("2020-01-01"))})
    pick = lambda *a, **k: {r.path for r in ranking.select_custom(items, *a, **k).collect()}
    assert pick() == {"b", "c", "e"} and pick(1) == {"b"} and pick(2) == {"b", "c", "e"} and pick(3) == {"c", "e"}
    assert pick(checked=items.where("path = 'd'")) == {"b", "c"} and pick(checked=items.where("path IN ('a', 'e')")) == set()


def test_destination_names_beyond_two_thousand(spark):
    """Every path of a name gets one, however many there are."""
    paths = spark.range(2500).select(F.format_string("/s/%05d/v.mp4", "id").alias("path"))
    got = results.destination_names(paths, "/dest", spark.createDataFrame([("v_7.mp4",)], "name string"))
    want = {"/dest/v.mp4"} | {f"/dest/v_{i}.mp4" for i in range(1, 2501) if i != 7}
    assert {r.target for r in got.collect()} == want
