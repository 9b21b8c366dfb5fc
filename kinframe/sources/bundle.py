"""Results and their thumbnails as bundles: ZIP parts in a folder, made whole by a manifest.

A part has scan.json (results, deflated), thumbs.idx (deflated; a line a thumbnail: key, address, and place and length if the part holds the picture) and
thumbs.pack (pictures, one after another, as they come). A picture is known by its SHA-256, so equal ones are stored once in a bundle,
in the part that its address decides. One part is a ZIP that other programs can open.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType

#: The entries of a part, in the order in which they are written.
ENTRIES = ("scan.json", "thumbs.pack", "thumbs.idx")
ITEM, PICTURE, KEY = 0, 1, 2
ROWS = "kind int, key string, address string, body binary"
MANIFEST = "bundle.json"
#: Rows of a batch that become Python objects at once.
ROWS_AT_ONCE = 64
#: Results and thumbnails of a part, where the caller doesn't say how many parts.
PER_PART = 200_000


@F.pandas_udf(StringType())
def _xxh64(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode("utf-16-le", "surrogatepass")))


def thumb_key(path: Column, at_s: Column, width: Column, quality: Column) -> Column:
    """The key of a thumbnail: XXH64 (seed 0, hexadecimal) of "path|seconds|width|quality" in UTF-16; null if any is."""
    return _xxh64(F.concat(path, F.format_string("|%.2f|", at_s), width.cast("string"), F.lit("|"), quality.cast("string")))


def thumb_places(n: int) -> list[float]:
    """Where n thumbnails of a video lie, as shares of its length."""
    return [k / (n + 1) for k in range(1, n + 1)]


def needs_thumbs(count: Column, placeholder: Column, width: Column, required: int = 0) -> Column:
    """Whether thumbnails must be made (again): none are there, the only one stands for a failure, or they are narrower than required."""
    narrow = (width > 0) & (width < required) if required > 0 else F.lit(False)
    return (F.coalesce(count, F.lit(0)) == 0) | ((count == 1) & F.coalesce(placeholder, F.lit(False))) | F.coalesce(narrow, F.lit(False))


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a path, which must be one that pyarrow can open, from executors too."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None, rows: int):
        self.name, self.rows = name, rows


class _Writer(DataSourceArrowWriter):
    """Tasks write parts under names of their own; the manifest that lists them is renamed into place last."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        name, rows, place, index, last = f"part-{uuid.uuid4().hex}.zip", 0, 0, {}, None
        entry = zipped = None
        try:
            for batch in iterator:
                for r in (r for i in range(0, batch.num_rows, ROWS_AT_ONCE) for r in batch.slice(i, ROWS_AT_ONCE).to_pylist()):
                    if zipped is None:
                        out = files.open_output_stream(f"{root}/{name}")
                        zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    if r["kind"] != last:
                        if last is not None and r["kind"] < last:
                            raise ValueError("a part's rows must come by kind")
                        self._end(entry, last)
                        last, first = r["kind"], True
                        # results and keys are packed; pictures are as they come, so that each can be read from its place
                        entry = zipped.open(zipfile.ZipInfo(ENTRIES[last]) if last == PICTURE else ENTRIES[last], "w", force_zip64=True)
                        entry.write(b'{"version":1,"items":[' if last == ITEM else b"")
                    if last == ITEM:
                        entry.write((b"" if first else b",\n") + r["body"])
                    elif last == PICTURE:
                        index[r["address"]] = (place, len(r["body"]))
                        place += len(r["body"])
                        entry.write(r["body"])
                    else:
                        entry.write((json.dumps([r["key"], r["address"], *index.get(r["address"], ())]) + "\n").encode())
                    first, rows = False, rows + 1
            self._end(entry, last)
            if zipped is not None:
                zipped.close()
                out.close()
        except BaseException:
            if zipped is not None:
                out.close()
                files.delete_file(f"{root}/{name}")
            raise
        return _Written(name if rows else None, rows)

    @staticmethod
    def _end(entry, kind: int | None) -> None:
        if entry is not None:
            entry.write(b"]}" if kind == ITEM else b"")
            entry.close()

    def commit(self, messages: list) -> None:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        names = sorted(m.name for m in messages if m and m.name)
        pending = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with files.open_output_stream(pending) as out:
            out.write(json.dumps({"parts": names, "rows": sum(m.rows for m in messages if m)}).encode())
        files.move(pending, f"{root}/{MANIFEST}")
        for i in files.get_file_info(fs.FileSelector(root)):  # of the bundle before, and of tasks that were lost
            if i.base_name.startswith("part-") and i.base_name not in names:
                files.delete_file(i.path)

    def abort(self, messages: list) -> None:
        files, root = _folder(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{root}/{m.name}")


def _names(files: fs.FileSystem, root: str) -> list[str]:
    at = f"{root}/{MANIFEST}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return []
    with files.open_input_file(at) as f:
        return json.loads(f.read())["parts"]


class _Reader(DataSourceReader):
    """A task a part; rows as they were written, pictures only where their part holds them."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        files, root = _folder(self.path)
        if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no bundle in {self.path}")
        return [_Part(n) for n in _names(files, root)]

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        if partition is None:  # a bundle of nothing
            return
        files, root = _folder(self.path)
        with files.open_input_file(f"{root}/{partition.name}") as f, zipfile.ZipFile(f) as z:
            has = set(z.namelist())
            if ENTRIES[ITEM] in has:
                with z.open(ENTRIES[ITEM]) as e:
                    for line in e:  # an item a line
                        text = line.decode().strip().removeprefix('{"version":1,"items":[').removesuffix("]}").removesuffix(",")
                        yield (ITEM, None, None, text.encode())
            if ENTRIES[KEY] in has:
                with z.open(ENTRIES[KEY]) as e:
                    pictures = z.open(ENTRIES[PICTURE]) if ENTRIES[PICTURE] in has else None
                    told = set()
                    for line in e:
                        key, address, *where = json.loads(line)
                        if key is not None:
                            yield (KEY, key, address, None)
                        if where and address not in told:
                            told.add(address)
                            pictures.seek(where[0])
                            yield (PICTURE, None, address, pictures.read(where[1]))


class Bundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_bundle"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def save_bundle(items: DataFrame, thumbs: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes items (group_id, path, size, similarity, is_image) and thumbs (key, picture) as a bundle of ``parts`` parts (one a 200,000 rows, if not said).

    A bundle that is there is replaced, once the new one is whole. Thumbs with a null key or picture, or an empty picture,
    are left out; of a repeated key the least address stays. Items are dealt by their path and pictures by their
    address, so no group or picture that many share weighs on one part; a part is a task.
    """
    parts = (items.count() + thumbs.count()) // PER_PART + 1 if parts is None else parts
    if parts < 1:
        raise ValueError("a bundle has a part at least")
    spark = items.sparkSession
    spark.dataSource.register(Bundles)
    info = F.struct(F.col("group_id").alias("groupId"), "path", F.col("size").alias("sizeLong"), F.col("similarity").cast("double").alias("similarity"), F.col("is_image").alias("isImage"))
    none = F.lit(None).cast("string")
    rows = items.select(F.xxhash64("path").alias("by"), F.lit(ITEM).alias("kind"), none.alias("key"), none.alias("address"), F.to_json(F.struct(info.alias("itemInfo"))).cast("binary").alias("body"))
    good = thumbs.where("key is not null and length(picture) > 0").select("key", F.sha2("picture", 256).alias("address"), "picture")
    keys = good.groupBy("key").agg(F.min("address").alias("address"))
    pictures = good.select("address", "picture").dropDuplicates(["address"]).join(keys.select("address").distinct(), "address", "left_semi")
    rows = rows.unionByName(keys.select(F.xxhash64("address").alias("by"), F.lit(KEY).alias("kind"), "key", "address", F.lit(None).cast("binary").alias("body")))
    rows = rows.unionByName(pictures.select(F.xxhash64("address").alias("by"), F.lit(PICTURE).alias("kind"), none.alias("key"), "address", F.col("picture").alias("body")))
    rows = rows.repartition(parts, "by").drop("by").sortWithinPartitions("kind", "address", "key")
    rows.write.format("media_bundle").mode("overwrite").option("path", path).save()


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The items and the thumbs (key, picture) of a bundle."""
    from kinframe.sources.files import read_results

    spark.dataSource.register(Bundles)
    rows = spark.read.format("media_bundle").option("path", path).load()
    items = read_results(rows.where(F.col("kind") == ITEM).select(F.concat(F.lit("["), F.col("body").cast("string"), F.lit("]")).alias("value")))
    pictures = rows.where(F.col("kind") == PICTURE).select("address", F.col("body").alias("picture"))
    return items, rows.where(F.col("kind") == KEY).select("key", "address").join(pictures, "address").select("key", "picture")
