"""Keeper ranking, selections and best flags: window expressions over groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Criteria in their default order: (name, column, larger is better, videos only).
CRITERIA = (
    ("Duration", "duration_s", True, True),
    ("Resolution", "frame_size", True, False),
    ("FPS", "fps", True, True),
    ("Bitrate", "bitrate_kbps", True, True),
    ("Audio Bitrate", "audio_kbps", True, False),
    ("HdrFormatRank", "hdr_rank", True, True),
    ("Size", "size", False, False),
    ("Audio Sample Rate", "audio_rate", True, False),
)
STRATEGIES = ("smallest_file", "shortest_duration", "worst_resolution", "hundred_percent_only", "lowest_quality")
AUTOSELECT = ("lowest_quality", "smallest_file", "oldest", "newest", "hundred_percent_equal")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a row number from 0 over all rows: rows are range-partitioned, counted and numbered inside partitions."""
    from .grouping import kept

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_i", inside).join(F.broadcast(counts), "_p").withColumn(name, (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_p", "_i", "_before")


def criteria_order(names: list[str] | None = None, image_group: Column | None = None) -> list[Column]:
    """Sort order of the criteria; named ones first in the given order, the rest after. Video-only ones don't rank images."""
    known = {c[0].lower(): c for c in CRITERIA}
    chosen = [known[n.lower()] for n in dict.fromkeys(names or []) if n.lower() in known]
    chosen += [c for c in CRITERIA if c not in chosen]
    image = F.col("is_image") if image_group is None else image_group
    out = []
    for _, col, larger, video in chosen:
        c = F.when(image, F.lit(None)).otherwise(F.col(col)) if video else F.col(col)
        out.append(c.desc_nulls_last() if larger else c.asc_nulls_last())
    return out


def keepers(items: DataFrame, names: list[str] | None = None) -> DataFrame:
    """items with keeper: whether a row is its group's best by the criteria in turn, then by path.

    Narrowing ties criterion by criterion is a lexicographic order. A group is of images if its first item by
    path is one.
    """
    image = F.min_by("is_image", "path").over(Window.partitionBy("group_id"))
    rows = items.withColumn("_image", image)
    w = Window.partitionBy("group_id").orderBy(*criteria_order(names, F.col("_image")), "path")
    return rows.withColumn("keeper", F.row_number().over(w) == 1).drop("_image")


def select_all_but_keeper(items: DataFrame, names: list[str] | None = None) -> DataFrame:
    return keepers(items, names).where(~F.col("keeper")).drop("keeper")


def best_flags(items: DataFrame) -> DataFrame:
    """items with is_best_* flags: all rows that tie for their group's best; size is best when smallest.

    Values that only videos have are not flagged in groups whose first item is an image.
    """
    w = Window.partitionBy("group_id")
    video = ~F.min_by("is_image", "path").over(w)
    best = lambda c: F.col(c) == F.max(c).over(w)
    return items.withColumns(
        {
            "is_best_duration": video & best("duration_s"),
            "is_best_fps": video & best("fps"),
            "is_best_bitrate": video & best("bitrate_kbps"),
            "is_best_audio_rate": video & best("audio_rate"),
            "is_best_audio_bitrate": video & best("audio_kbps"),
            "is_best_hdr": video & best("hdr_rank"),
            "is_best_size": F.col("size") == F.min("size").over(w),
            "is_best_frame_size": best("frame_size"),
        }
    )


def _quality() -> list[Column]:
    return [F.col(c).desc() for c in ("is_best_bitrate", "is_best_frame_size", "bitrate_kbps", "frame_size", "size")]


def strategy_deletions(items: DataFrame, strategy: str) -> DataFrame:
    """Rows to delete: all but one of each group of two or more, by a named strategy; ties keep the first path."""
    order = {
        "smallest_file": [F.col("size").desc()],
        "shortest_duration": [F.col("duration_s").desc()],
        "worst_resolution": [F.col("frame_size").desc()],
        "hundred_percent_only": [],
        "lowest_quality": _quality(),
    }[strategy]
    w = Window.partitionBy("group_id")
    rows = best_flags(items) if strategy == "lowest_quality" else items
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_rn": F.row_number().over(w.orderBy(*order, "path")), "_low": F.min("similarity").over(w)})
    rows = rows.where("_n >= 2 and _rn > 1")
    if strategy == "hundred_percent_only":
        rows = rows.where("_low >= 100")
    return rows.select(*items.columns)


def autoselect(items: DataFrame, mode: str) -> DataFrame:
    """The one row of each group that a mode selects."""
    rows = items.where(F.abs(F.col("similarity") - 100) < 0.01) if mode == "hundred_percent_equal" else items
    order = {
        "lowest_quality": [F.col("frame_size"), F.col("bitrate_kbps")],
        "smallest_file": [F.col("size")],
        "oldest": [F.col("date_created")],
        "newest": [F.col("date_created").desc()],
        "hundred_percent_equal": [],
    }[mode]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("group_id").orderBy(*order, "path"))).where("_rn = 1").drop("_rn")


#: What two rows must share to count as identical; the second leaves the size out.
IDENTITY = ("size", "duration_s", "frame_size", "fps", "bitrate_kbps", "audio_kbps", "audio_rate", "hdr_rank", "is_image")


def select_identical(items: DataFrame, with_size: bool = True) -> DataFrame:
    """All but the first (by path) of rows of a group that agree in everything."""
    same = [c for c in IDENTITY if with_size or c != "size"]
    w = Window.partitionBy("group_id", *same).orderBy("path")
    return items.withColumn("_rn", F.row_number().over(w)).where("_rn > 1").drop("_rn")


def select_but_one(items: DataFrame, newest: bool) -> DataFrame:
    """All but the newest (or oldest) of each group."""
    order = F.col("date_created").desc() if newest else F.col("date_created")
    return items.withColumn("_rn", F.row_number().over(Window.partitionBy("group_id").orderBy(order, "path"))).where("_rn > 1").drop("_rn")


def select_custom(items: DataFrame, identity: int = 0, date_order: int = 0, checked: DataFrame | None = None) -> DataFrame:
    """Of each group (rows that the caller's filter has left) all but one of the rows that an identity mode takes together.

    Modes: 0 the whole group, 1 rows equal to the group's first (by path) in everything, 2 in everything but size,
    3 rows that differ from it. The first is always one of them. date_order 0 leaves the first by path out, 1 the
    oldest, 2 the newest. Groups of which a path is in ``checked`` are skipped.
    """
    w = Window.partitionBy("group_id")
    rows = items
    if checked is not None:
        rows = rows.join(items.join(checked.select("path").distinct(), "path", "left_semi").select("group_id").distinct(), "group_id", "left_anti")
    first = F.min_by(F.struct(*IDENTITY), "path").over(w)
    rows = rows.withColumns({"_first": first, "_head": F.col("path") == F.min("path").over(w)})
    same = lambda names: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_first.{c}")) for c in names))
    full, but_size = same(IDENTITY), same([c for c in IDENTITY if c != "size"])
    take = {0: F.lit(True), 1: full, 2: but_size, 3: ~full | ~but_size}[identity]
    order = {0: [], 1: [F.col("date_created")], 2: [F.col("date_created").desc()]}[date_order]
    rows = rows.where(take | F.col("_head")).withColumn("_rn", F.row_number().over(w.orderBy(*order, "path")))
    return rows.where("_rn > 1").select(*items.columns)


def hover_difference(items: DataFrame) -> DataFrame:
    """(group_id, path, size_delta, bitrate_delta, duration_delta): distance to the group's best in percent or seconds; = if under half a percent."""
    w = Window.partitionBy("group_id")

    def percent(c: str, best: Column) -> Column:
        d = (F.col(c) - best) * 100.0 / best
        return F.when(best == 0, "=").when(F.abs(d) < 0.5, "=").otherwise(F.concat(F.when(d > 0, "+").otherwise("-"), F.floor(F.abs(d) + 0.5).cast("long").cast("string"), F.lit("%")))

    gap = F.col("duration_s") - F.max("duration_s").over(w)
    return items.select(
        "group_id",
        "path",
        percent("size", F.min("size").over(w)).alias("size_delta"),
        percent("bitrate_kbps", F.max("bitrate_kbps").over(w)).alias("bitrate_delta"),
        F.when(gap == 0, "=").otherwise(F.concat(gap.cast("string"), F.lit("s"))).alias("duration_delta"),
    )


def card_badges(items: DataFrame) -> DataFrame:
    """(group_id, path, keep_best, best_size, best_bitrate): the first of the highest bitrate; badges only for unique maxima, size too."""
    w = Window.partitionBy("group_id")
    alone = lambda c: (F.col(c) == F.max(c).over(w)) & (F.count(F.lit(1)).over(Window.partitionBy("group_id", c)) == 1)
    first = F.row_number().over(w.orderBy(F.col("bitrate_kbps").desc(), "path")) == 1
    return items.select("group_id", "path", first.alias("keep_best"), alone("size").alias("best_size"), alone("bitrate_kbps").alias("best_bitrate"))


def _weighted(tap: float):
    return lambda s, x: s + x * tap


def smooth(rows: DataFrame, keys: list[str], order: str, value: str = "chroma", taps: tuple[float, ...] = (0.25, 0.5, 1.0, 0.5, 0.25)) -> DataFrame:
    """Weighted mean of each row's array with the ones before it, element by element; null until there are enough."""
    w = Window.partitionBy(*keys).orderBy(order)
    past = [F.lag(value, len(taps) - 1 - k).over(w) if k < len(taps) - 1 else F.col(value) for k in range(len(taps))]
    rows = rows.withColumns({f"_t{k}": p for k, p in enumerate(past)})
    total = F.transform(F.col("_t0"), lambda x: x * taps[0])
    for k in range(1, len(taps)):
        total = F.zip_with(total, F.col(f"_t{k}"), _weighted(taps[k]))
    return rows.withColumn("smooth", F.when(F.col("_t0").isNotNull(), F.transform(total, lambda x: x / sum(taps)))).drop(*(f"_t{k}" for k in range(len(taps))))
