"""File listings and result files."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.functions import kernels as K

ITEM = "group_id long, path string, size long, duration_s double, frame_size int, fps double, bitrate_kbps long, audio_format string, audio_rate int, similarity double, is_image boolean"


def listing(spark: SparkSession, roots: list[str], recursive: bool = True, images: bool = True) -> DataFrame:
    """(path, folder, file_size, modified) of media files below the roots; contents aren't read."""
    out = None
    for r in roots:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(r)
        out = one if out is None else out.unionByName(one)
    path = F.regexp_replace("path", "^file:", "")
    rows = out.select(path.alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"])
    return rows.where(K.is_media(F.col("path"), images)).withColumn("folder", K.folder_of(F.col("path")))


def generate_catalog(spark: SparkSession, n: int = 50_000, copies_every: int = 0, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """A synthetic catalog of n rows, or of one for each row of ``ids`` (column id); with copies_every, each such row repeats the features of the one before it."""
    src = F.when(F.lit(copies_every > 0) & (F.col("id") % max(1, copies_every) == 0) & (F.col("id") > 0), F.col("id") - 1).otherwise(F.col("id"))
    rows = (spark.range(n) if ids is None else ids.select("id")).withColumn("src", src)
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("src")), F.lit(m))
    return rows.select(
        "id",
        F.format_string("/catalog/f%03d/video%08d.mp4", (F.col("id") % 500).cast("int"), "id").alias("path"),
        F.format_string("/catalog/f%03d", (F.col("id") % 500).cast("int")).alias("folder"),
        (1_000_000 + h(1, 4_000_000_000)).alias("file_size"),
        (5 + h(2, 3596)).cast("double").alias("duration_s"),
        F.xxhash64(F.lit(seed), F.col("src")).alias("phash"),
    )


def results_json(items: DataFrame) -> DataFrame:
    """One JSON document a group: its items by falling similarity."""
    fields = [c for c in items.columns if c != "group_id"]
    order = F.struct((-F.col("similarity")).alias("_s"), F.col("path").alias("_p"), F.struct(*fields).alias("v"))
    g = items.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["v"]).alias("items"))
    return g.select("group_id", F.to_json(F.struct("group_id", "items")).alias("json"))


def save_results(items: DataFrame, path: str) -> None:
    """Results as JSON documents, one a group; the commit makes the whole set appear or none of it."""
    info = F.struct(F.col("group_id").alias("groupId"), "path", F.col("size").alias("sizeLong"), F.col("similarity").cast("double").alias("similarity"), F.col("is_image").alias("isImage"))
    docs = items.groupBy("group_id").agg(F.collect_list(F.struct(info.alias("itemInfo"))).alias("items"))
    docs.select(F.to_json(F.struct(F.lit(1).alias("version"), "items")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark.read.text(path))


def read_results(texts: DataFrame, column: str = "value") -> DataFrame:
    """Items of result documents: an envelope {version, items: [{itemInfo}]}, an array of such, or of plain items.

    Key casing doesn't matter. Items without a path are dropped; a document that none is left of raises.
    """
    item = "struct<groupId:long,path:string,sizeLong:long,similarity:double,isImage:boolean>"
    wrapped = f"struct<itemInfo:{item},groupId:long,path:string,sizeLong:long,similarity:double,isImage:boolean>"
    text = F.trim(F.col(column))
    for k in ("items", "version", "itemInfo", "groupId", "path", "sizeLong", "similarity", "isImage"):
        text = F.regexp_replace(text, rf'"(?i:{k})"\s*:', f'"{k}":')
    whole = F.when(text.startswith("["), F.concat(F.lit('{"items":'), text, F.lit("}"))).otherwise(text)
    rows = texts.withColumn("_doc", F.from_json(whole, f"version int, items array<{wrapped}>", {"mode": "PERMISSIVE"}))
    rows = rows.withColumn("_i", F.filter(F.transform("_doc.items", lambda x: F.coalesce(x["itemInfo"], F.struct(x["groupId"].alias("groupId"), x["path"].alias("path"), x["sizeLong"].alias("sizeLong"), x["similarity"].alias("similarity"), x["isImage"].alias("isImage")))), lambda x: x["path"].isNotNull()))
    good = F.when(F.coalesce(F.size("_i"), F.lit(0)) > 0, F.col("_i")).otherwise(F.raise_error(F.lit("no valid item in results")).cast(f"array<{item}>"))
    return rows.select(F.explode(good).alias("i")).select(F.col("i.groupId").alias("group_id"), "i.path", F.col("i.sizeLong").alias("size"), "i.similarity", F.col("i.isImage").alias("is_image"))


#: The columns of the two CSV exports, in their order.
CSV_COLUMNS = ("GroupId", "Similarity", "Path", "Size", "Duration", "FrameSize", "Format", "Fps", "BitRateKbs", "AudioFormat", "DateCreated", "IsImage", "Flags", "PartialClipOffset")
SHEET_COLUMNS = ("GroupId", "Path", "SizeBytes", "Duration", "Resolution", "Fps", "BitrateKbs", "AudioFormat", "AudioSampleRate", "Similarity", "DateCreated", "IsImage", "Checked")


def _or(items: DataFrame, name: str, otherwise: str = "") -> Column:
    """A column as text; what is missing or null is ``otherwise``."""
    return F.coalesce(F.col(name).cast("string"), F.lit(otherwise)) if name in items.columns else F.lit(otherwise)


def _bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def csv_lines(items: DataFrame) -> DataFrame:
    """(group_id, similarity, path, line): a CSV line an item, to be ordered by group and falling similarity."""
    created = F.date_format("date_created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "date_created" in items.columns else F.lit("")
    f: list[Column] = [
        F.col("group_id").cast("string"), F.format_string("%.1f", F.col("similarity").cast("double")), K.csv_field(F.col("path")), F.col("size").cast("string"),
        F.format_string("%.3f", F.col("duration_s").cast("double")), K.csv_field(F.col("frame_size")), K.csv_field(_or(items, "format")), F.format_string("%.2f", F.col("fps").cast("double")),
        F.col("bitrate_kbps").cast("string"), K.csv_field(_or(items, "audio_format")), F.coalesce(created, F.lit("")), _bool(F.col("is_image")), _or(items, "flags", "0"), _or(items, "offset_s", "0"),
    ]
    return items.select("group_id", "similarity", "path", F.concat_ws(",", *f).alias("line"))


def sheet_lines(items: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """(group_id, path, line): the export for spreadsheet programs; with ``checked`` (column path) it tells which are."""
    created = F.date_format("date_created", "yyyy-MM-dd HH:mm:ss") if "date_created" in items.columns else F.lit("")
    f: list[Column] = [
        F.col("group_id").cast("string"), K.csv_field(F.col("path")), F.col("size").cast("string"), _duration(F.col("duration_s")), K.csv_field(_or(items, "frame_size")), F.col("fps").cast("string"),
        F.col("bitrate_kbps").cast("string"), K.csv_field(_or(items, "audio_format")), F.col("audio_rate").cast("string"), F.col("similarity").cast("string"), F.coalesce(created, F.lit("")), _bool(F.col("is_image")),
    ]
    rows = items
    if checked is not None:
        rows = items.join(checked.select("path").distinct().withColumn("_c", F.lit(True)), "path", "left")
        f.append(_bool(F.col("_c").isNotNull()))
    return rows.select("group_id", "path", F.concat_ws(",", *f).alias("line"))


def _duration(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.expr("CAST(0 AS BIGINT)") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def write_lines(lines: DataFrame, order: list[str], path: str, header: tuple[str, ...], bom: bool = False) -> None:
    """Writes a column ``line`` in order as text, part files in the order of their names, the header first; a byte order mark is for spreadsheet programs."""
    spark = lines.sparkSession
    head = (codecs.BOM_UTF8.decode() if bom else "") + ",".join(header)
    rows = lines.select(F.lit(1).alias("_part"), *order, "line")
    first = spark.createDataFrame([(head,)], "head string").select(F.lit(0).alias("_part"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), F.col("head").alias("line"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.unionByName(first)
    rows.repartitionByRange(parts, "_part", *order).sortWithinPartitions("_part", *order).select("line").write.mode("overwrite").text(path)


def text_report(items: DataFrame) -> DataFrame:
    """(group_id, place, line): numbered groups with a head line (place 0), items by falling similarity, each with a line of details, a blank line.

    Two rows without a group_id come before all: how many groups and files there are, and a blank line.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("group_id")
    size = items.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    from kinframe.operators.ranking import best_flags, global_rank

    heads = global_rank(size, [F.col("group_id")], "no").select("group_id", F.lit(0).alias("place"), F.format_string("Group %d (%d files):", F.col("no") + 1, "n").alias("line"))
    rows = best_flags(items).withColumn("place", F.row_number().over(w.orderBy(F.col("similarity").desc(), "path")))
    best = F.when(F.col("is_best_bitrate") | F.col("is_best_frame_size"), " [best]").otherwise("")
    clip = F.when(F.col("offset_s") > 0, F.concat(F.lit(" [partial clip "), K.clip_offset(F.col("offset_s")), F.lit("]"))).otherwise("") if "offset_s" in items.columns else F.lit("")
    line = F.concat(F.format_string("  %6.1f%%  ", F.col("similarity").cast("double")), F.col("path"), best, clip)
    about = F.concat(F.lit(" " * 9), _or(items, "frame_size", "?"), F.lit(", "), _or(items, "format", "?"))
    about = F.when(F.col("is_image"), about).otherwise(F.concat(about, F.format_string(", %.2f fps, ", F.col("fps").cast("double")), F.col("bitrate_kbps").cast("string"), F.lit(" kbps, "), _duration(F.col("duration_s"))))
    found = size.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("f"))
    top = found.select(F.posexplode(F.array(F.format_string("Found %d duplicate group(s), %d total file(s).", "g", "f"), F.lit(""))).alias("place", "line"))
    top = top.select(F.lit(None).cast(items.schema["group_id"].dataType).alias("group_id"), "place", "line")
    blank = size.select("group_id", (F.col("n") + 1).cast("int").alias("place"), F.lit("").alias("line"))
    return top.unionByName(heads).unionByName(rows.select("group_id", "place", F.concat(line, F.lit("\n"), about).alias("line"))).unionByName(blank)


def blacklist(texts: DataFrame, column: str = "value") -> DataFrame:
    """(entry_id, paths) of a blacklist document: {version, groups: [[...]]} or the array alone; broken text gives none."""
    text = F.trim(F.col(column))
    whole = F.when(text.startswith("["), F.concat(F.lit('{"groups":'), text, F.lit("}"))).otherwise(text)
    rows = texts.select(F.from_json(whole, "version int, groups array<array<string>>").alias("d"))
    return rows.select(F.posexplode_outer("d.groups").alias("entry_id", "paths")).where("paths is not null")
