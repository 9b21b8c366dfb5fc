"""Result tables: statistics, totals, pages, blacklists, relocation, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import kernels as K


def group_stats(items: DataFrame) -> DataFrame:
    """n_groups, n_items, mean and largest group size, groups over 5 and over 10."""
    sizes = items.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        F.round(F.avg("n"), 6).alias("avg_size"),
        F.max("n").alias("max_size"),
        F.count_if(F.col("n") > 5).alias("over_5"),
        F.count_if(F.col("n") > 10).alias("over_10"),
    )


def totals(items: DataFrame, singletons: bool = False) -> DataFrame:
    """Groups (of two or more, unless singletons count), files, bytes, and what is saved if only the largest file stays."""
    size = F.greatest(F.col("size"), F.lit(0))
    g = items.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.max(size).alias("largest"))
    g = g if singletons else g.where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_files"), F.sum("total").alias("total_bytes"), F.sum(F.col("total") - F.col("largest")).alias("savings"))


def drop_singletons(items: DataFrame) -> DataFrame:
    return items.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("group_id"))).where("_n > 1").drop("_n")


def remove_items(items: DataFrame, paths: DataFrame) -> DataFrame:
    """items without the paths, and without groups of which one is left."""
    return drop_singletons(items.join(paths.select("path").distinct(), "path", "left_anti"))


def cleanup_report(items: DataFrame, selected: DataFrame) -> DataFrame:
    """(group_id, removed, kept, n_removed, n_kept, savings) of groups with selected rows."""
    marked = items.join(selected.select("path").distinct().withColumn("gone", F.lit(True)), "path", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    report = marked.groupBy("group_id").agg(
        F.concat_ws("|", F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("path"))))).alias("removed"),
        F.concat_ws("|", F.array_sort(F.collect_list(F.when(~F.col("gone"), F.col("path"))))).alias("kept"),
        F.count_if("gone").alias("n_removed"),
        F.count_if(~F.col("gone")).alias("n_kept"),
        F.sum(F.when(F.col("gone"), F.col("size")).otherwise(0)).alias("savings"),
    )
    return report.where("n_removed > 0")


def operation_totals(log: DataFrame) -> DataFrame:
    """(done, failed, freed_bytes) of a log (ok, size)."""
    return log.agg(F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.greatest("size", F.lit(0)))), F.lit(0)).alias("freed_bytes"))


def page_groups(items: DataFrame, page: int, size: int) -> DataFrame:
    """The items of a page of groups in the order of group ids; page from 1, size from 1 to 200."""
    page, size = max(1, page), min(max(1, size), 200)
    ids = items.select("group_id").distinct().orderBy("group_id").offset((page - 1) * size).limit(size)
    return items.join(F.broadcast(ids), "group_id", "left_semi")  # 200 ids at the most


#: Sort orders by name: the column or group value, and whether it falls.
SORTS = {f"{n}_{d}": (c, d == "desc") for n, c in (("size", "size"), ("resolution", "frame_size"), ("duration", "duration_s"), ("date", "date_created"), ("similarity", "similarity"), ("group_size", "_members"), ("group_total", "_total"), ("group_checked", "_checked")) for d in ("asc", "desc")}


def sort_key(items: DataFrame, name: str, checked: str | None = None) -> DataFrame:
    """items with sort_value, by which the named order sorts (group values over the whole group)."""
    column, _ = SORTS[name]
    w = Window.partitionBy("group_id")
    values = {"_members": F.count(F.lit(1)).over(w), "_total": F.sum("size").over(w), "_checked": F.max(F.col(checked).cast("int")).over(w) if checked else F.lit(0)}
    return items.withColumn("sort_value", values.get(column, F.col(column)))


def sorted_places(items: DataFrame, name: str | None, checked: str | None = None) -> DataFrame:
    """items with ``place`` (from 0) in one of the 17 orders (None: by group): groups stay together, led by their best row.

    Ties go by group, then path. Rows are numbered by range partitions, so no task sorts everything.
    """
    from .ranking import global_rank

    if name is None:
        return global_rank(items, [F.col("group_id"), F.col("path")], "place")
    falls = SORTS[name][1]
    w = Window.partitionBy("group_id")
    keyed = sort_key(items, name, checked)
    keyed = keyed.withColumn("_lead", (F.max if falls else F.min)("sort_value").over(w))
    way = (lambda c: F.col(c).desc()) if falls else F.col
    return global_rank(keyed, [way("_lead"), F.col("group_id"), way("sort_value"), F.col("path")], "place").drop("_lead", "sort_value")


def view_filter(items: DataFrame, term: str | None = None, kind: str = "all", low: float = 0, high: float = 100, checked_groups: bool = False) -> DataFrame:
    """Rows shown: a path that holds the term or shares a group with one that does, a media kind, a similarity range."""
    w = Window.partitionBy("group_id")
    out = items
    if term:
        out = out.withColumn("_hit", F.max(F.lower("path").contains(term.lower()).cast("int")).over(w)).where("_hit = 1").drop("_hit")
    if checked_groups:
        out = out.withColumn("_c", F.max(F.col("checked").cast("int")).over(w)).where("_c = 1").drop("_c")
    if kind != "all":
        out = out.where(F.col("is_image") == (kind == "image"))
    return out.where(F.col("similarity").between(low, high))


def blacklisted_groups(items: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Ids of groups all of whose paths are in one entry (entry_id, paths) of the blacklist; an equi-join on paths and a count."""
    members = items.select("group_id", "path").distinct()
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    entries = blacklist.select("entry_id", F.explode(F.array_distinct("paths")).alias("path"))
    hits = members.join(entries, "path").groupBy("group_id", "entry_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "group_id").where("hits = n").select("group_id").distinct()


def apply_blacklist(items: DataFrame, blacklist: DataFrame) -> DataFrame:
    return items.join(blacklisted_groups(items, blacklist), "group_id", "left_anti")


def prune_blacklist(blacklist: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries all of whose paths still exist."""
    gone = blacklist.select("entry_id", F.explode("paths").alias("path")).join(existing.select("path"), "path", "left_anti")
    return blacklist.join(gone.select("entry_id").distinct(), "entry_id", "left_anti")


def not_a_match(items: DataFrame, blacklist: DataFrame, group_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(items, blacklist) after groups were marked as no match: their paths become entries, the groups go."""
    chosen = F.col("group_id").isin(group_ids)
    new = items.where(chosen).groupBy("group_id").agg(F.collect_set("path").alias("paths")).select(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("entry_id"), "paths")
    return drop_singletons(items.where(~chosen)), blacklist.select(F.col("entry_id").cast("string").alias("entry_id"), "paths").unionByName(new)


def lookup_paths(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows whose path, in any case, is listed."""
    return items.join(paths.select(F.lower("path").alias("_low")).distinct(), F.lower(items["path"]) == F.col("_low"), "left_semi")


def relocate_prefix(items: DataFrame, old: str, new: str) -> DataFrame:
    """Paths below the old folder moved below the new one."""
    a, b = K.prefix_with_slash(old), K.prefix_with_slash(new)
    return items.withColumn("path", F.when(F.col("path").startswith(a), F.concat(F.lit(b), F.substr("path", F.lit(len(a) + 1)))).otherwise(F.col("path")))


def relocate_missing(missing: DataFrame, found: DataFrame) -> DataFrame:
    """(path, new_path, confidence): where missing files (path, size, modified_s, duration_s) may have gone.

    One found file of that size: size_only. Of several, those within 2 s of the time and half a second of the
    duration count: one is resolved, more are ambiguous, none is not_found.
    """
    other = found.select(F.col("path").alias("_new"), "size", F.col("modified_s").alias("_m"), F.col("duration_s").alias("_d"))
    both = missing.join(other, "size", "left")
    fine = (F.abs(F.col("modified_s") - F.col("_m")) <= 2) & (F.abs(F.col("duration_s") - F.col("_d")) <= 0.5)
    g = both.groupBy("path").agg(F.count("_new").alias("n"), F.min("_new").alias("one"), F.count_if(F.coalesce(fine, F.lit(False))).alias("k"), F.min(F.when(fine, F.col("_new"))).alias("best"))
    kind = F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "size_only").when(F.col("k") == 1, "resolved").when(F.col("k") > 1, "ambiguous").otherwise("not_found")
    new = F.when(kind == "size_only", F.col("one")).when(kind == "resolved", F.col("best"))
    return g.select("path", new.alias("new_path"), kind.alias("confidence"))


def link_keeper(items: DataFrame, selected: DataFrame) -> DataFrame:
    """(path, target): each selected row and the most similar unselected row of its group to link it to (null if none)."""
    chosen = selected.select("path").distinct()
    rest = items.join(chosen, "path", "left_anti")
    w = Window.partitionBy("group_id").orderBy(F.col("similarity").desc(), "path")
    best = rest.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("group_id", F.col("path").alias("target"))
    return items.join(chosen, "path", "left_semi").join(best, "group_id", "left").select("path", "target")


def collapse_hard_links(items: DataFrame, file_id: str = "file_id") -> DataFrame:
    """The first path of each file in a group; groups of one file go."""
    w = Window.partitionBy("group_id", file_id).orderBy("path")
    return drop_singletons(items.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def destination_names(paths: DataFrame, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """(path, target): names in a folder that are all different and none of which ``existing`` (column name) has.

    The first path of a name keeps it, unless the folder has it already; all others get _1, _2, ... before the
    extension, the numbers left out that would give a name which another path has or which exists.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parts = lambda d: d.withColumns({"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "ext": F.regexp_extract("name", r"(\.[^.]*)$", 1)})
    rows = parts(paths.select("path", name.alias("name")))
    there = rows.select("name", F.lit(False).alias("exists"))
    if existing is not None:
        there = there.unionByName(existing.select("name", F.lit(True).alias("exists")))
    there = parts(there.groupBy("name").agg(F.max("exists").alias("exists")))
    # the numbers that are taken beside each name: of v.mp4 those of v_3.mp4
    taken = there.select(F.regexp_extract("stem", r"^(.*)_([1-9][0-9]*)$", 1).alias("stem"), "ext", F.regexp_extract("stem", r"^(.*)_([1-9][0-9]*)$", 2).try_cast("long").alias("k")).where("k IS NOT NULL")
    taken = taken.groupBy("stem", "ext").agg(F.array_sort(F.collect_list("k")).alias("taken"))
    rows = rows.join(there.select("name", "exists"), "name").withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("path")) - 1 + F.col("exists").cast("int"))
    rows = rows.join(taken, ["stem", "ext"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<long>")))
    # the place-th number that isn't taken: as many more as there are taken ones with fewer free numbers below
    below = F.filter(F.transform("taken", lambda x, i: x - i), lambda free: free <= F.col("place"))
    number = (F.col("place") + F.size(below)).cast("string")
    free = F.when(F.col("place") == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), number, "ext"))
    return rows.select("path", F.concat(F.lit(K.prefix_with_slash(folder)), free).alias("target"))


def select_missing(items: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Rows whose path isn't among those on disk."""
    return items.join(on_disk.select("path").distinct(), "path", "left_anti")


def invert_checked(items: DataFrame, checked: DataFrame) -> DataFrame:
    """items with ``checked``: true for those that weren't among the checked paths."""
    marked = items.join(checked.select("path").distinct().withColumn("_c", F.lit(True)), "path", "left")
    return marked.withColumn("checked", F.col("_c").isNull()).drop("_c")


def clear_checked(items: DataFrame) -> DataFrame:
    """items, none of them checked."""
    return items.withColumn("checked", F.lit(False))


def project_items(items: DataFrame) -> DataFrame:
    """What clients see of an item: named for them, without frames, hashes and fingerprints."""
    names = {"path": "path", "folder": "folder", "size": "size_bytes", "duration_s": "duration_seconds", "frame_size": "frame_size", "fps": "fps", "bitrate_kbps": "bitrate_kbs", "format": "format", "audio_format": "audio_format", "audio_channel": "audio_channel", "audio_rate": "audio_sample_rate", "audio_kbps": "audio_bitrate_kbs", "similarity": "similarity", "date_created": "date_created", "is_image": "is_image", "hdr": "hdr_format", "flags": "flags", "offset_s": "partial_clip_offset_seconds", "group_id": "group_id"}
    return items.select(*(F.col(c).alias(n) for c, n in names.items() if c in items.columns))


def catalog_search(catalog: DataFrame, text: str) -> DataFrame:
    """Rows whose path holds the text in any casing; all rows for an empty text."""
    return catalog.where(F.contains(F.lower("path"), F.lit(text.strip().lower()))) if text.strip() else catalog


def action_plan(selected: DataFrame, action: str, targets: DataFrame | None = None) -> DataFrame:
    """(action, path, size, target): what would be done; nothing is touched."""
    out = selected.select(F.lit(action).alias("action"), "path", "size")
    if targets is None:
        return out.withColumn("target", F.lit(None).cast("string"))
    return out.join(targets.select("path", "target"), "path", "left").select("action", "path", "size", "target")


def recent(log: DataFrame, n: int, time: str = "ts") -> DataFrame:
    """The newest n rows of an audit log."""
    return log.orderBy(F.col(time).desc(), *[c for c in log.columns if c != time]).limit(n)
