"""Where decoding plugs in: a function of the caller's that turns a file into features, run over a catalog's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K
from kinframe.functions.phash import phash
from kinframe.operators import grouping


class MetadataError(Exception):
    """The file can't be probed."""


class FrameError(Exception):
    """The file can't be decoded."""


@dataclass
class Decoded:
    """What an adapter gives: probe output (see sources.probe), a grey 32 x 32 frame a position, a value of 32 bits a second of sound."""

    probe: str | None = None
    frames: list[bytes | None] = field(default_factory=list)
    fingerprint: list[int] | None = None


#: (path, relative positions) -> Decoded; an external decoder, a library or a test's table.
Decoder = Callable[[str, list[float]], Decoded]

#: (path, seconds) -> a grey frame for each of them, None where there is none.
FrameDecoder = Callable[[str, list[float]], list[bytes | None]]

_OUT = "path string, probe string, frames array<binary>, fp array<long>, error int, too_dark boolean"


def all_dark(frames: list[bytes | None]) -> bool:
    """Every frame is there and mostly black; no frames: False."""
    return bool(frames) and all(f is not None and len(f) > 0 and 100.0 * sum(x <= K.DARK for x in f) / len(f) >= K.DARK_SHARE for f in frames)


def gather(catalog: DataFrame, decode: Decoder, config: ScanConfig) -> DataFrame:
    """catalog (path, flags, ...) with probe, frames and fp of every row, and its flags as decoding went.

    One call a file, spread over the cluster; a failing file sets its flag and the others go on. Rows that an
    earlier run has flagged are left as they are, unless errors are retried; rows that need no work are never sent
    to Python. Frames that are all mostly black set the too-dark flag, a missing fingerprint the no-audio flag, one
    of zeros the silent flag.
    """
    positions = config.position_list()
    bad = K.FLAGS["metadata_error"] | K.FLAGS["thumbnail_error"]
    work = catalog.where(F.lit(config.retry_errors) | ~K.has_any(F.col("flags"), bad)).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    d = decode(path, positions)
                    black = all_dark(d.frames)
                    rows.append((path, d.probe, d.frames, d.fingerprint, 0, black))
                except MetadataError:
                    rows.append((path, None, None, None, K.FLAGS["metadata_error"], False))
                except FrameError:
                    rows.append((path, None, None, None, K.FLAGS["thumbnail_error"], False))
            yield pd.DataFrame(rows, columns=["path", "probe", "frames", "fp", "error", "too_dark"])

    done = work.mapInPandas(run, _OUT).withColumn("_seen", F.lit(True))
    out = catalog.join(done, "path", "left")
    silent = F.coalesce((F.size("fp") > 0) & F.forall("fp", lambda x: x == 0), F.lit(False))
    fresh = F.when(F.col("_seen"), F.col("flags").bitwiseAND(F.lit(~bad)).bitwiseOR(F.col("error"))).otherwise(F.col("flags"))
    for name, on in (("too_dark", F.col("too_dark")), ("no_audio", F.col("_seen") & (F.col("error") == 0) & F.col("fp").isNull()), ("silent_audio", silent)):
        fresh = F.when(F.coalesce(on, F.lit(False)), fresh.bitwiseOR(F.lit(K.FLAGS[name]))).otherwise(fresh)
    return out.withColumn("flags", fresh).drop("_seen", "error", "too_dark")


def asked_positions(catalog: DataFrame, config: ScanConfig) -> DataFrame:
    """(path, at_us): where frames of each video are sampled, in microseconds; images have one frame, at 0.

    A position is a share of the duration, or of config.max_sampling_s where the video is longer than that.
    """
    length = F.col("duration_s")
    if config.max_sampling_s > 0:
        length = F.when(length > config.max_sampling_s, F.lit(config.max_sampling_s)).otherwise(length)
    at = F.transform(F.array(*(F.lit(x) for x in config.position_list())), lambda x: F.round(length * x * 1_000_000).cast("long"))
    image = F.coalesce("is_image", F.lit(False)) if "is_image" in catalog.columns else F.lit(False)
    return catalog.select("path", F.explode(F.array_distinct(F.when(image, F.array(F.lit(0).cast("long"))).otherwise(at))).alias("at_us"))


def missing_positions(catalog: DataFrame, features: DataFrame, config: ScanConfig) -> DataFrame:
    """(path, at_us) that ``features`` (path, at_us, frame) doesn't hold, of rows that are to be gathered."""
    bad = K.FLAGS["metadata_error"] | K.FLAGS["thumbnail_error"]
    work = catalog.where(F.lit(config.retry_errors) | ~K.has_any(F.col("flags"), bad))
    return asked_positions(work, config).join(features.select("path", "at_us"), ["path", "at_us"], "left_anti").where("at_us IS NOT NULL")


def gather_missing(catalog: DataFrame, features: DataFrame, decode: FrameDecoder, config: ScanConfig) -> tuple[DataFrame, DataFrame]:
    """The catalog with its flags, and the feature table (path, at_us, frame, phash), after the missing frames are decoded.

    Features are kept by path and place in time, so a scan with other positions or another sampling limit decodes only
    what it doesn't have, and a file that lacks nothing never goes to Python. A file is opened once for all its
    missing places. If all frames sampled now are dark the row is flagged as too dark, whatever earlier scans
    sampled; a place that gives no frame, or a FrameError, sets the thumbnail error, and frames that came stay.
    Decoding happens once: its results are written to the shared folder first. Repeated paths count as one in the
    features; rows without a duration, or with null paths, ask for nothing; empty tables are fine.
    """
    need = missing_positions(catalog, features, config).groupBy("path").agg(F.array_sort(F.collect_set("at_us")).alias("at"))  # ten at the most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, at in zip(b["path"], b["at"]):
                try:
                    frames = list(decode(path, [int(x) / 1e6 for x in at]))
                except (FrameError, MetadataError):
                    frames = []
                lacks = len(frames) != len(at) or None in frames
                rows.append((path, [{"at_us": int(x), "frame": f} for x, f in zip(at, frames) if f is not None], lacks, all_dark(frames)))
            yield pd.DataFrame(rows, columns=["path", "frames", "lacks", "dark"])

    done = grouping.kept(need.mapInPandas(run, "path string, frames array<struct<at_us:long,frame:binary>>, lacks boolean, dark boolean"))
    new = done.select("path", F.explode("frames").alias("f")).select("path", "f.at_us", "f.frame")
    new = new.withColumn("phash", F.when(F.length("frame") == 1024, phash(F.when(F.length("frame") == 1024, F.col("frame")).otherwise(F.lit(bytes(1024))))))
    flags = F.col("flags").bitwiseAND(F.when(F.col("lacks").isNotNull(), F.lit(~K.FLAGS["thumbnail_error"])).otherwise(F.lit(-1)))
    for name, on in (("thumbnail_error", "lacks"), ("too_dark", "dark")):
        flags = F.when(F.coalesce(on, F.lit(False)), flags.bitwiseOR(F.lit(K.FLAGS[name]))).otherwise(flags)
    marked = catalog.join(done.select("path", "lacks", "dark"), "path", "left").withColumn("flags", flags).select(*catalog.columns)
    return marked, features.select("path", "at_us", "frame", "phash").unionByName(new)
