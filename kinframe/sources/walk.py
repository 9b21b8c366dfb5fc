"""Listing folders level by level, and dates from the headers of pictures; both run in tasks on whatever holds the files.

A path without a scheme (or file:) is read with the system's calls, so that links and write permission are known; any
other goes through Arrow's file systems (hdfs, s3, gs). Contents are never opened while folders are listed.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import os
import struct
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K
from kinframe.operators.grouping import kept

#: Tries of a listing that fails for another reason than a missing or closed folder, and seconds before the second.
TRIES, WAIT_S = 3, 0.1
_ROWS = "kind string, path string, folder string, file_size long, modified timestamp, reason string"


def pruned(path: str, exclude: tuple[str, ...]) -> bool:
    """Whether a folder isn't entered: an entry is its whole path, or a pattern for its path (with a slash) or its name; case doesn't matter."""
    low, name = path.lower(), path.rstrip("/").rsplit("/", 1)[-1].lower()
    for entry in (e.lower().rstrip("/") for e in exclude):
        if "*" in entry or "?" in entry:
            if fnmatch.fnmatchcase(low if "/" in entry else name, entry.replace("[", "[[]")):
                return True
        elif low == entry:
            return True
    return False


def _entries(folder: str, config: ScanConfig, read_only: bool) -> Iterator[tuple[str, str, int, float]]:
    """(kind, path, size, modified) of what lies directly in a folder."""
    if "://" not in folder:
        real = os.path.realpath(folder)
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if config.skip_reparse_points and e.is_symlink() or not read_only and not os.access(e.path, os.W_OK):
                        continue
                    if e.is_dir():
                        # a link to a folder above would never end
                        if not (e.is_symlink() and (real + "/").startswith(os.path.realpath(e.path).rstrip("/") + "/")):
                            yield "folder", e.path, 0, 0.0
                    elif e.is_file():
                        s = e.stat()
                        yield "file", e.path, s.st_size, s.st_mtime
                except OSError:
                    continue  # it went away, or may not be looked at
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    scheme = folder[: len(folder) - len(path)] if folder.endswith(path) else folder.split("://", 1)[0] + "://"
    for i in system.get_file_info(fs.FileSelector(path)):
        if i.type == fs.FileType.Directory:
            yield "folder", scheme + i.path, 0, 0.0
        elif i.type == fs.FileType.File:
            yield "file", scheme + i.path, i.size, i.mtime.timestamp() if i.mtime else 0.0


def _level(config: ScanConfig, read_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                rows, reason = [], None
                for k in range(TRIES):
                    try:
                        for kind, path, size, at in _entries(folder, config, read_only):
                            if kind == "file" or (config.recursive and not pruned(path, config.exclude)):
                                rows.append((kind, path, folder, size, np.datetime64(int(at * 1e6), "us"), None))
                        reason = None
                        break
                    except (FileNotFoundError, NotADirectoryError):
                        reason = "missing"
                        break
                    except PermissionError:
                        reason = "inaccessible"
                        break
                    except OSError as e:
                        rows, reason = [], f"failed: {e.strerror or e}"
                        time.sleep(WAIT_S * 2**k)
                if reason:
                    rows.append(("error", folder, folder, 0, None, reason))
                out = pd.DataFrame(rows, columns=["kind", "path", "folder", "file_size", "modified", "reason"])
                yield out.astype({"file_size": "int64", "modified": "datetime64[us]"})

    return run


def walk(spark: SparkSession, config: ScanConfig, read_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Media files below config.include, and the folders that could not be listed.

    Files: path, folder, file_size, modified; each once, also where roots overlap. Unreachable: path, is_root, reason
    (missing, inaccessible, or what failed after TRIES tries with growing waits); the other folders are listed all
    the same. Each level of folders is listed by as many tasks as there are partitions and written before the next, so
    a lost executor costs a level's share. Excluded folders are not entered, links to folders above neither; with
    config.skip_reparse_points no links at all, and without ``read_only`` nothing that can't be written. No roots
    give empty results.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    roots = [r.rstrip("/") or "/" for r in dict.fromkeys(config.include)]
    level = spark.createDataFrame([(r,) for r in roots], "path string").dropDuplicates(["path"])
    seen, found = level, []
    while True:
        found.append(kept(level.repartition(parts, "path").mapInPandas(_level(config, read_only), _ROWS)))
        level = found[-1].where("kind = 'folder'").select("path").distinct().join(seen, "path", "left_anti")
        if level.isEmpty():
            break
        level = kept(level)
        seen = seen.unionByName(level)
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    files = rows.where("kind = 'file'").where(K.is_media(F.col("path"), config.images)).select("path", "folder", "file_size", "modified")
    missed = rows.where("kind = 'error'").select("path", F.col("path").isin(*roots).alias("is_root") if roots else F.lit(False).alias("is_root"), "reason")
    return files, missed


# --- dates in headers --------------------------------------------------------------------------------------

#: Fixed values of the formats: tags of a picture's dates, and the most that is read of one header.
TAG_CHANGED, TAG_EXIF, TAG_TAKEN, MOST = 0x0132, 0x8769, 0x9003, 1 << 20


def _chunks(f, at: int, head: str, order: tuple[int, int], pad: int, tail: int) -> Iterator[tuple[bytes, int]]:
    """(name, length) of chunks from ``at`` on, with f at the data of each; ``order`` says which field is which."""
    while True:
        f.seek(at)
        raw = f.read(8)
        if len(raw) < 8:
            return
        fields = struct.unpack(head, raw)
        name, size = fields[order[0]], fields[order[1]]
        yield name, size
        at += 8 + size + tail + (size & pad)


def tiff_block(f) -> bytes | None:
    """The block of tags that a TIFF is, or a JPEG, PNG or WebP file holds; None if there is none."""
    start = f.read(12)
    if start[:4] in (b"II*\0", b"MM\0*"):
        f.seek(0)
        return f.read(MOST)
    if start[:2] == b"\xff\xd8":
        at = 2
        while True:
            f.seek(at)
            raw = f.read(4)
            if len(raw) < 4 or raw[0] != 0xFF or raw[1] in (0xDA, 0xD9):
                return None
            size = int.from_bytes(raw[2:], "big")
            if size < 2:
                return None
            if raw[1] == 0xE1 and (data := f.read(size - 2))[:6] == b"Exif\0\0":  # another kind of block may come first
                return data[6:]
            at += 2 + size
    if start[:4] == b"\x89PNG":
        for name, size in _chunks(f, 8, ">I4s", (1, 0), 0, 4):
            if size > MOST or name in (b"IDAT", b"IEND"):
                return None
            if name == b"eXIf":
                return f.read(size)
    if start[:4] == b"RIFF" and start[8:] == b"WEBP":
        for name, size in _chunks(f, 12, "<4sI", (0, 1), 1, 0):
            if size > MOST:
                return None
            if name == b"EXIF":
                data = f.read(size)
                return data[6:] if data[:6] == b"Exif\0\0" else data
    return None


def _tags(block: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    """(type, count, value field) of each tag of a directory."""
    if at + 2 > len(block):
        return {}
    n = struct.unpack_from(order + "H", block, at)[0]
    if n > 512:
        return {}
    raw = (block[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n))
    return {tag: (kind, count, value) for tag, kind, count, value in (struct.unpack(order + "HHI4s", x) for x in raw if len(x) == 12)}


def date_taken(f) -> dt.datetime | None:
    """When a picture was taken (else: last changed) by its header; f is a binary file that can seek. None if it doesn't say."""
    block = tiff_block(f)
    if block is None or len(block) < 8 or block[:2] not in (b"II", b"MM"):
        return None
    order = "<" if block[:2] == b"II" else ">"
    magic, first = struct.unpack_from(order + "HI", block, 2)
    if magic != 42:
        return None

    def text(tag: tuple[int, int, bytes] | None) -> str | None:
        if tag is None or tag[0] != 2 or not 0 < tag[1] <= 64:
            return None
        at = struct.unpack(order + "I", tag[2])[0]
        raw = tag[2][: tag[1]] if tag[1] <= 4 else block[at : at + tag[1]]
        return raw.decode("ascii", "replace").strip("\0 ") if len(raw) == tag[1] else None

    own = _tags(block, first, order)
    taken = None
    if TAG_EXIF in own and own[TAG_EXIF][0] in (3, 4):
        taken = text(_tags(block, struct.unpack(order + "I", own[TAG_EXIF][2])[0], order).get(TAG_TAKEN))
    told = taken if taken is not None else text(own.get(TAG_CHANGED))
    try:
        return dt.datetime.strptime(told, "%Y:%m:%d %H:%M:%S") if told else None
    except ValueError:
        return None


def header_dates(files: DataFrame, path: str = "path") -> DataFrame:
    """files with date_taken (local time, null if the header tells none or the file can't be read); only headers are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["path"]:
                try:
                    if "://" in p:
                        from pyarrow import fs

                        system, at = fs.FileSystem.from_uri(p)
                        with system.open_input_file(at) as f:
                            out.append(date_taken(f))
                    else:
                        with open(p, "rb") as f:
                            out.append(date_taken(f))
                except (OSError, struct.error):
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "date_taken": pd.Series(out, dtype="datetime64[us]")})

    dates = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct().mapInPandas(run, "path string, date_taken timestamp")
    return files.join(dates.withColumnRenamed("path", path), path, "left")
