"""The catalog as snapshots of Parquet: upserts, dirty rows, cleaning, updates."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinframe.functions import kernels as K

#: Columns that hold features; a light scan leaves them out.
HEAVY = ("frames", "phashes", "fingerprint", "streams")


def upsert(catalog: DataFrame, listed: DataFrame, changed_by: list[str], key: str = "path") -> DataFrame:
    """The catalog after a listing: new rows come in, rows that differ in ``changed_by`` are replaced, all others keep their features.

    Rows that weren't listed stay. Columns that the listing lacks are null in rows that it brings. ``state`` is
    kept, new or replaced.
    """
    old, new = catalog.alias("o"), listed.alias("n")
    same = F.lit(True)
    for c in changed_by:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    state = F.when(F.col(f"o.{key}").isNull(), "new").when(F.col(f"n.{key}").isNull() | same, "kept").otherwise("replaced")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").withColumn("state", state)
    value = lambda c: F.when(F.col("state") == "kept", F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in listed.columns else F.lit(None))
    return both.select(*(value(c).alias(c) for c in catalog.columns), "state")


def light(catalog: DataFrame) -> DataFrame:
    """Without the heavy columns, which the scan then doesn't read."""
    return catalog.drop(*HEAVY)


def heavy_of(catalog: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """The heavy columns of the given rows, fetched late."""
    return catalog.select(key, *(c for c in HEAVY if c in catalog.columns)).join(keys.select(key).distinct(), key, "left_semi")


def union_roots(*listings: DataFrame) -> DataFrame:
    out = listings[0]
    for x in listings[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["path"])


def dirty_rows(catalog: DataFrame) -> DataFrame:
    return catalog.where("dirty").drop("dirty")


def compact(snapshot: DataFrame, deltas: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """The latest version of every key in a snapshot and what was appended to it; of equal versions the row that is greatest in all its columns."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), *(F.col(c).desc() for c in snapshot.columns if c != key))
    return snapshot.unionByName(deltas).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def delete_paths(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("path").distinct(), "path", "left_anti")


def clean(catalog: DataFrame) -> DataFrame:
    """Rows whose file is there and that have no metadata or thumbnail error."""
    bad = K.FLAGS["metadata_error"] | K.FLAGS["thumbnail_error"]
    return catalog.where(F.col("on_disk") & ~K.has_any(F.col("flags"), bad))


def _is(which: str | Column) -> Column:
    return F.col("path") == which if isinstance(which, str) else which


def rename(catalog: DataFrame, which: str | Column, new: str) -> DataFrame:
    """Gives the row of a path (or those that a condition names) another path."""
    return catalog.withColumn("path", F.when(_is(which), F.lit(new)).otherwise(F.col("path")))


def exclude_path(catalog: DataFrame, which: str | Column) -> DataFrame:
    """Marks one path (or the rows that a condition names) as excluded by hand."""
    flags = F.col("flags")
    return catalog.withColumn("flags", F.when(_is(which), K.with_flag(flags, K.FLAGS["manually_excluded"])).otherwise(flags))


def forget_image_hashes(catalog: DataFrame, columns: tuple[str, ...] = ("frames", "phashes")) -> DataFrame:
    """Clears images' features and everyone's too-dark flag, as after a change of the hashing."""
    out = catalog.withColumn("flags", K.with_flag(F.col("flags"), K.FLAGS["too_dark"], False))
    for c in columns:
        if c in catalog.columns:
            out = out.withColumn(c, F.when(F.col("is_image"), F.lit(None)).otherwise(F.col(c)))
    return out


def browse(catalog: DataFrame, folder: str, roots: tuple[str, ...]) -> DataFrame:
    """(name, is_folder, files): what lies directly in a folder, which must be a root or below one."""
    at = folder.rstrip("/")
    if not any(at == r.rstrip("/") or at.startswith(r.rstrip("/") + "/") for r in roots):
        raise ValueError(f"{folder} is outside the roots")
    below = catalog.where(F.col("path").startswith(at + "/")).select(F.split(F.substr("path", F.lit(len(at) + 2)), "/").alias("s"))
    return below.groupBy(F.get("s", F.lit(0)).alias("name"), (F.size("s") > 1).alias("is_folder")).agg(F.count(F.lit(1)).alias("files"))


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[str]:
    """The committed versions of a catalog, oldest first."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n[len("manifest-") :] for n in names if n.startswith("manifest-"))


def save(catalog: DataFrame, path: str, keep: int = 2) -> str:
    """Writes the catalog as a new version under ``path`` and commits it; the name of the version.

    A version is a folder of Parquet parts; the manifest that names it, and holds its columns, is written last, to a name
    of its own that is then renamed, so a write that fails leaves the version before it in place, whole. The last ``keep`` versions
    stay; folders without a manifest, and older ones, go once the commit is done.
    """
    spark = catalog.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    catalog.write.parquet(f"{path}/version-{name}")
    fs, root = _files(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = fs.create(hadoop.Path(f"{path}/pending-{name}"))
    out.writeBytes(catalog.schema.json())
    out.close()
    if not fs.rename(hadoop.Path(f"{path}/pending-{name}"), hadoop.Path(f"{path}/manifest-{name}")):
        raise OSError(f"can't commit {path}/manifest-{name}")
    good = set(versions(spark, path)[-keep:])
    for s in fs.listStatus(root):
        kind, _, of = s.getPath().getName().partition("-")
        if kind in ("manifest", "version", "pending") and of not in good and of <= name:
            fs.delete(s.getPath(), True)
    return name


def load(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The last committed version (or the one named); parts that can't be read are left out, see damaged()."""
    known = versions(spark, path)
    if not known or (version and version not in known):
        raise FileNotFoundError(f"no committed version in {path}")
    name = version or known[-1]
    columns = StructType.fromJson(json.loads(spark.read.text(f"{path}/manifest-{name}", wholetext=True).first()[0]))
    return spark.read.schema(columns).option("ignoreCorruptFiles", "true").parquet(f"{path}/version-{name}")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the last version's parts of which no row can be read: what load() leaves out, for the quarantine."""
    last = f"{path}/version-{versions(spark, path)[-1]}"
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("file")
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(last).where("length > 0").select(name(F.col("path")))
    read = load(spark, path).select(name(F.col("_metadata.file_path"))).distinct()
    return parts.join(read, "file", "left_anti")


def append_dirty(catalog: DataFrame, path: str) -> None:
    """Adds the changed rows to the last version: later rows of a path stand for earlier ones until compact()."""
    dirty_rows(catalog).write.mode("append").parquet(f"{path}/version-{versions(catalog.sparkSession, path)[-1]}")


def export_json(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
