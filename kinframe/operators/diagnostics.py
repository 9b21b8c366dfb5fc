"""Why a pair matches or doesn't: every gate as a column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K

from . import blocks
from .clips import MAX_RATIO, sliding_match
from .pairs import PAIR_COLUMNS, QUICK_BITS, duration_pairs, gates, metric


def explain_pairs(pairs: DataFrame, config: ScanConfig, side: int = 8) -> DataFrame:
    """(a_id, b_id, gate_<name>..., distance, difference, metric_ok, verdict) of pairs (a, b)."""
    ok = gates(config)
    d = K.hamming(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))
    diff, _ = metric(config, side)
    fits = d <= config.max_bits if config.use_phash else F.coalesce(~F.isnan(diff) & (diff.cast("float") <= F.lit(config.limit).cast("float")), F.lit(False))
    rows = pairs.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *(c.alias(f"gate_{n}") for n, c in ok.items()), d.alias("distance"), F.round(diff, 6).alias("difference"), fits.alias("metric_ok"))
    failed = F.concat_ws(", ", *(F.when(~F.col(f"gate_{n}"), n) for n in ok), F.when(~F.col("metric_ok"), "metric"))
    return rows.withColumn("verdict", F.when(failed == "", "match").otherwise(F.concat(F.lit("no match: "), failed)))


def explain_clip(pairs: DataFrame, min_ratio: float = 0.1, min_similarity: float = 0.8) -> DataFrame:
    """The clip gates of pairs (s, c), with the best alignment at any similarity."""
    ratio = F.col("c.duration_s") / F.col("s.duration_s")
    best = sliding_match(F.col("c.fp"), F.col("s.fp"), 0.0)
    rows = pairs.select(
        F.col("s.id").alias("source_id"),
        F.col("c.id").alias("clip_id"),
        F.round(ratio, 6).alias("ratio"),
        ((ratio >= min_ratio) & (ratio < MAX_RATIO)).alias("ratio_ok"),
        ((F.col("s.duration_s") >= 1) & (F.col("c.duration_s") >= 1)).alias("duration_ok"),
        (F.size("c.fp") < F.size("s.fp")).alias("length_ok"),
        best["similarity"].alias("similarity"),
        best["offset"].alias("offset_s"),
        sliding_match(F.col("c.fp"), F.col("s.fp"), min_similarity).isNotNull().alias("similarity_ok"),
    )
    names = ("ratio", "duration", "length", "similarity")
    failed = F.concat_ws(", ", *(F.when(~F.coalesce(F.col(f"{n}_ok"), F.lit(False)), n) for n in names))
    return rows.withColumn("verdict", F.when(failed == "", "clip").otherwise(F.concat(F.lit("no clip: "), failed)))


def gate_counters(pairs: DataFrame, config: ScanConfig) -> DataFrame:
    """One row: pairs in all, and for each gate how many are left after it and those before it."""
    names, left, ok = [], [], F.lit(True)
    for name, gate in gates(config).items():
        ok = ok & F.coalesce(gate, F.lit(False))
        names.append(name)
        left.append(ok)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), *(F.count_if(c).alias(f"after_{n}") for n, c in zip(names, left)))


def gate_counters_within(videos: DataFrame, within: ScanConfig, config: ScanConfig) -> DataFrame:
    """gate_counters() of all pairs of videos whose durations are within the tolerance of ``within``; no pair becomes a row.

    Videos meet in blocks by buckets of duration, and a task counts a pair of blocks as matrices. Folders are no
    numbers: where their gate is on, pairs are made.
    """
    if config.folder_mode != "any":
        return gate_counters(duration_pairs(videos, within, PAIR_COLUMNS), config)
    known = lambda c: F.col(c).isNotNull().alias(f"has_{c}")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    rows = videos.where("NOT is_image AND duration_s IS NOT NULL").withColumn("h", K.whole_hash(F.col("lo"), F.col("hi")))
    rows = rows.select("id", F.col("duration_s").cast("double").alias("duration_s"), blocks.duration_bucket(F.col("duration_s"), within).cast("long").alias("bucket"), *(number(c) for c in ("h", "size", "width", "height", "file_id")), *(known(c) for c in ("h", "size", "file_id")))
    names = list(gates(config))

    def tolerance(d: np.ndarray, c: ScanConfig) -> np.ndarray:
        if c.duration_percent <= 0:
            return np.full(len(d), float(max(c.duration_min_s, c.duration_max_s)))
        out = d * (c.duration_percent / 100.0)
        out = np.maximum(out, c.duration_min_s) if c.duration_min_s > 0 else out
        return np.minimum(out, c.duration_max_s) if c.duration_max_s > 0 else out

    def count(x: dict, y: dict, own: bool) -> list[int]:
        of = lambda name: (x[name][:, None], y[name][None])
        (xi, yi), (xd, yd) = of("id"), of("duration_s")
        apart = np.abs(xd - yd)
        fits = lambda c: apart <= np.minimum(tolerance(x["duration_s"], c)[:, None], tolerance(y["duration_s"], c)[None])
        ok = fits(within) & ((xi < yi) if own else (xi != yi))
        (xh, yh), (xk, yk), (xs, ys), (xw, yw), (xt, yt) = (of(c) for c in ("h", "has_h", "size", "width", "height"))

        def size() -> np.ndarray | bool:
            if config.size_percent <= 0:
                return True
            share = config.size_percent / 100.0
            band = lambda a, b: (b >= (a * (1.0 - share)).astype(np.int64)) & (b <= (a * (1.0 + share)).astype(np.int64))
            return np.where(xi < yi, band(xs, ys), band(ys, xs)) & x["has_size"][:, None] & y["has_size"][None]

        def resolution() -> np.ndarray | bool:
            if not config.resolution_gate:
                return True
            half = lambda a, b: np.minimum(a, b) >= np.maximum(a, b) // 2
            return ~((xw > 0) & (xt > 0) & (yw > 0) & (yt > 0)) | (half(xw, yw) & half(xt, yt))

        def hard_link() -> np.ndarray | bool:
            a, b = of("file_id")
            return ((a != b) & x["has_file_id"][:, None] & y["has_file_id"][None]) if config.skip_hard_links else True

        test = {"quick": lambda: (np.bitwise_count(xh ^ yh) <= QUICK_BITS) | ~(xk & yk), "duration": lambda: fits(config), "size": size, "resolution": resolution, "hard_link": hard_link}
        out = [int(np.count_nonzero(ok))]
        for name in names:  # kind: all are videos; folder: see above
            ok = ok & test[name]() if name in test else ok
            out.append(int(np.count_nonzero(ok)))
        return out

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values for c in ("x", "y"))
                x, y = ({f.name: v.field(f.name).to_numpy(zero_copy_only=False) for f in v.type} for v in (x, y))
                for v in (x, y):
                    v["h"] = v["h"].view(np.uint64)
                own, step, total = batch.column("own")[k].as_py(), max(1, blocks.PAIRS // len(y["id"])), np.zeros(len(names) + 1, dtype=np.int64)
                for i in range(0, len(x["id"]), step):
                    total += count({n: v[i : i + step] for n, v in x.items()}, y, own)
                yield pa.RecordBatch.from_arrays([pa.array([n]) for n in total.tolist()], names=told)

    told = ["pairs", *(f"after_{n}" for n in names)]
    found = blocks.bucket_blocks(rows, 2).mapInArrow(counted, ", ".join(f"{n} long" for n in told))
    return found.agg(*(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in told))


def fingerprint_lengths(videos: DataFrame) -> DataFrame:
    """(n, shortest, longest) of the fingerprints there are."""
    return videos.where("fp IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("fp")).alias("shortest"), F.max(F.size("fp")).alias("longest"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, n, total): values up to each bound (its number from 0), above the last one in the bucket after it; nulls count nowhere."""
    bucket = F.lit(len(bounds))
    for k, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col(value) <= b, F.lit(k)).otherwise(bucket)
    return rows.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what is counted on the way when it is run: named aggregates without a job of their own."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in metrics.items())), seen
