"""Frame comparison by blocks: rows of a cell meet in blocks of bounded size, whose frames are compared as matrices.

Grey frames have no selective key: the mean level is the only bound on their difference that a shuffle can use. So
items go to cells of (kind, duration bucket, band of mean level), a cell is cut into blocks, and a block meets each
block of its own and of the next cells once. Only ids and frames are shuffled, and only pairs that match come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K

#: Items of a block in a cell of up to CUTS blocks, bytes of its frames; both grow fourfold in larger cells.
BLOCK, BYTES, CUTS = 4096, 1 << 18, 32
#: The most that (1 - cos t) / t comes to, rounded up, and turns of the waves over the mean difference that are tried.
SLOPE, SPEEDS = 0.7246114, (0.4, 0.7, 1.0, 1.25, 1.5, 1.75, 2.1)
#: Pixels that a comparison holds at a time, pairs that it tells at a time, and pieces of a frame whose sums are compared first.
PIXELS, PAIRS, FOLDS = 1 << 22, 1 << 18, 64
#: Pairs of a tile whose sums are added up one column after another, in what a core's cache holds.
TILE, TILE_ROWS = 1 << 15, 4096


def _bytes(frame) -> bytes | None:
    """A frame (ints from 0 to 255, or bytes), or an array of them one after the other; null if there is none or one is null."""
    if frame is None or isinstance(frame, bytes):
        return frame
    if len(frame) and not isinstance(frame[0], (int, float, np.number)):
        each = [_bytes(f) for f in frame]
        return None if None in each else b"".join(each)
    return np.asarray(frame, dtype=np.uint8).tobytes()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose frames are there, with the frames as bytes and their mean level."""
    for b in batches:
        known = [_bytes(f) for f in b["frame"]]
        out = b.drop(columns="frame").assign(bytes=known)[[bool(x) for x in known]]
        yield out.assign(mean=[float(np.frombuffer(x, dtype=np.uint8).mean()) for x in out["bytes"]])


def duration_bucket(duration: Column, config: ScanConfig) -> Column:
    """A bucket that grows with the tolerance: durations within it of one another are two buckets apart at the most.

    Where the tolerance is constant (its least and most) buckets are that wide, between them they are a tolerance
    wide each, which is even in the logarithm. So a bucket's number, and what it is compared with, don't grow with
    the length of videos.
    """
    share, least, most = config.duration_percent / 100.0, float(config.duration_min_s), float(config.duration_max_s)
    d = F.greatest(duration, F.lit(0.0))
    if share <= 0:
        width = max(least, most)
        return F.floor(d / F.lit(width)) if width > 0 else F.xxhash64(duration)
    low, high = least / share if least > 0 else 1e-3, most / share if most > 0 else math.inf
    if high <= low:  # the most holds all over
        return F.floor(d / F.lit(most))
    first = math.floor(low / least) if least > 0 else 0
    out = F.lit(first + 1) + F.floor(F.log(F.greatest(d, F.lit(low)) / F.lit(low)) / F.lit(math.log1p(share)))
    if high < math.inf:
        steps = first + 2 + math.floor(math.log(high / low) / math.log1p(share))
        out = F.when(d >= F.lit(high), F.lit(steps) + F.floor((d - F.lit(high)) / F.lit(most))).otherwise(out)
    below = F.floor(d / F.lit(least)) if least > 0 else F.lit(0).cast("long")
    return F.when(d < F.lit(low), below).otherwise(out)


def _sums(a: np.ndarray, b: np.ndarray, most: int = 255) -> np.ndarray:
    """Sums of absolute differences of all rows of a with all of b; values from 0 to ``most``.

    Goes tile by tile and column by column, in two bytes a pair as long as neither a value nor a sum needs more.
    """
    kind = np.int16 if most <= np.iinfo(np.int16).max else np.int64
    x, y = (np.ascontiguousarray(f.T.astype(kind)) for f in (a, b))
    part = max(1, np.iinfo(np.uint16).max // most) if kind == np.int16 else len(x)  # columns whose sum fits two bytes
    whole = np.dtype(np.uint16 if part >= len(x) else np.int64)
    out = np.zeros((len(a), len(b)), dtype=whole if kind == np.int16 else np.int64)
    for j in range(0, len(b), TILE_ROWS):
        n = min(TILE_ROWS, len(b) - j)
        step = max(1, TILE // n)
        held = np.empty((step, n), dtype=kind)
        for i in range(0, len(a), step):
            d = held[: min(step, len(a) - i)]
            unsigned, to = d.view(np.uint16 if kind == np.int16 else np.int64), out[i : i + step, j : j + n]
            for first in range(0, len(x), part):
                total = to if part >= len(x) else np.zeros(d.shape, dtype=np.uint16)
                for k in range(first, min(first + part, len(x))):
                    np.subtract(x[k, i : i + step, None], y[k, j : j + n], out=d)
                    np.abs(d, out=d)
                    total += unsigned
                if part < len(x):
                    to += total
    return out


def _masked(x: np.ndarray, y: np.ndarray, black: bool, white: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums of absolute differences, numbers) of the pixels that no mask hides, of all rows of x with all of y; exact.

    With hidden pixels at 0 a sum also counts the pixels that are hidden on one side only; they are taken off again.
    """
    kind = np.float32 if x.shape[1] * 255 < 1 << 24 else np.float64  # whole numbers up to there are exact

    def shown(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = ((f > K.DARK) if black else np.ones(f.shape, dtype=bool)) & ((f < K.WHITE) if white else True)
        return keep.astype(kind), f * keep

    (p, u), (q, v) = shown(x), shown(y)
    total = _sums(u, v).astype(kind)
    total -= u.sum(axis=1, dtype=kind)[:, None] - u.astype(kind) @ q.T
    total -= v.sum(axis=1, dtype=kind)[None] - p @ v.T.astype(kind)
    return total, p @ q.T


def _differences(a: np.ndarray, b: np.ndarray, positions: int, black: bool, white: bool) -> np.ndarray:
    """Mean differences (a share of 256) of all rows of a with all of b: by position, then their mean; NaN where a position has no pixel left."""
    n, m, width = len(a), len(b), a.shape[1] // positions
    out = np.zeros((n, m), dtype=np.float32 if black or white else np.float64)
    for p in range(positions):
        x, y = a[:, p * width : (p + 1) * width], b[:, p * width : (p + 1) * width]
        if not (black or white):
            out += _sums(x, y).astype(np.float64) / width / 256.0
            continue
        total, left = _masked(x, y, black, white)
        with np.errstate(invalid="ignore"):
            out += (total.astype(np.float32) / left.astype(np.float32)).astype(np.float32) / np.float32(256.0)
    return out / positions


def _folded(f: np.ndarray, pieces: int) -> np.ndarray:
    return f.reshape(len(f), pieces, -1).sum(axis=2, dtype=np.int32)


def _waves(values: np.ndarray, speed: float) -> np.ndarray:
    """Cosines and sines of whole numbers: a row's product with another one's is the sum of the cosines of their differences."""
    at = np.arange(int(values.max(initial=0)) + 1) * speed
    return np.concatenate([np.cos(at).astype(np.float32)[values], np.sin(at).astype(np.float32)[values]], axis=1)


class _Filter(NamedTuple):
    """How pairs over a limit are told by a matrix product: pieces of a frame, speed of the waves, least product, waves of b."""

    pieces: int
    speed: float
    least: float
    waves: np.ndarray


def _filter(a: np.ndarray, b: np.ndarray, limit: float) -> _Filter | None:
    """The filter that settles nearly all pairs of rows of a and b, found on a few of them; None if there is none.

    As 1 - cos t <= SLOPE |t|, frames within a limit have a least sum of cosines of their pixels' differences; so have
    the sums of pieces of the frames, which can't differ by more than their pixels do.
    """
    size = a.shape[1]
    most = limit * 256.0 * size * (1 + 1e-6) + 1
    pieces = FOLDS if size % FOLDS == 0 else size
    x, y = a[:: max(1, len(a) // 32)], b[:: max(1, len(b) // 64)]
    while True:
        u, v = _folded(x, pieces), _folded(y, pieces)
        apart = float(_sums(u, v, 255 * size // pieces).mean()) / pieces
        best = None
        for speed in (t / apart for t in SPEEDS) if apart > 0 else ():
            least = pieces - SLOPE * speed * most - pieces * (pieces + 1) * 2.5e-7  # what single precision may lose
            share = float((_waves(u, speed) @ _waves(v, speed).T >= least).mean())
            if best is None or share < best[0]:
                best = (share, speed, least)
        if best is not None and best[0] < 1 / 16:
            return _Filter(pieces, best[1], best[2], _waves(_folded(b, pieces), best[1]))
        if pieces == size:
            return None
        pieces = 2 * pieces if size % (2 * pieces) == 0 else size


def _near(a: np.ndarray, b: np.ndarray, positions: int, by: _Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, difference) of the pairs that a filter leaves."""
    size, width = a.shape[1], a.shape[1] // positions
    p, q = np.divmod(np.flatnonzero(_waves(_folded(a, by.pieces), by.speed) @ by.waves.T >= by.least), len(b))
    out = np.empty(len(p))
    for k in range(0, len(p), max(1, PIXELS // size)):
        r, c = p[k : k + PIXELS // size], q[k : k + PIXELS // size]
        d = np.abs(a[r].astype(np.int16) - b[c]).reshape(len(r), positions, -1).sum(axis=2, dtype=np.int64)
        out[k : k + len(r)] = (d / width / 256.0).sum(axis=1) / positions
    return p, q, out


def _bounded(a: np.ndarray, b: np.ndarray, positions: int, limit: float, by: _Filter | None = None) -> np.ndarray:
    """_differences() without masks where they can be within the limit, infinite elsewhere; ``by`` if _filter() was asked before."""
    by = by or _filter(a, b, limit)
    if by is None:
        return _differences(a, b, positions, False, False)
    out = np.full((len(a), len(b)), np.inf)
    p, q, d = _near(a, b, positions, by)
    out[p, q] = d
    return out


def _mirrored(frames: np.ndarray, positions: int) -> np.ndarray:
    side = math.isqrt(frames.shape[1] // positions)
    return frames.reshape(len(frames), positions, side, side)[..., ::-1].reshape(len(frames), -1)


def frame_matches(items: DataFrame, config: ScanConfig, by_duration: bool = True, by_kind: bool = True, limit: float | None = None) -> DataFrame:
    """(a_id, b_id, difference, flipped) of pairs (a_id < b_id) whose frames differ by no more than the limit; exact.

    An item has a square ``frame``, or ``frames``, one for each of config.positions (images: one); the mean over
    the positions counts, and a position of which a mask leaves nothing spoils the pair. With by_duration only pairs of one kind whose durations may be within tolerance are told (gates decide
    later); by_kind leaves images and videos apart. Rows without a frame match nothing; frames of unequal size
    don't match. The mirrored frame of a counts if it alone is better.
    """
    several = "frames" in items.columns
    black, white, positions = config.ignore_black, config.ignore_white, config.positions if several else 1
    limit = config.limit if limit is None else limit
    kind = F.col("is_image").cast("int") if by_kind and "is_image" in items.columns else F.lit(0)
    bucket = F.when(kind == 1, F.lit(-1)).otherwise(duration_bucket(F.col("duration_s"), config)) if by_duration and "duration_s" in items.columns else F.lit(-1)
    rows = items.select("id", kind.alias("kind"), bucket.cast("long").alias("bucket"), F.col("frames" if several else "frame").alias("frame"))
    rows = rows.mapInPandas(_packed, "id long, kind int, bucket long, bytes binary, mean double")
    width = max(limit * 256.0, 1e-6) + 1e-9
    band = F.lit(0) if black or white else F.floor(F.col("mean") / width)  # a mask may leave any difference of means
    rows = rows.select("id", "kind", "bucket", band.cast("long").alias("band"), F.length("bytes").alias("size"), "bytes")
    cell = ["kind", "bucket", "band", "size"]
    least = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BYTES) / F.col("size"))))
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*cell, F.ceil(F.col("n") / F.least(F.greatest(F.ceil(F.col("n") / CUTS), least), 4 * least)).alias("blocks"))
    dealt = rows.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = dealt.groupBy(*cell, "block").agg(F.collect_list(F.struct("id", "bytes")).alias("rows"))
    bands = [0] if black or white else [-1, 0, 1]
    steps = [(0, 0)] + ([(0, 1)] if len(bands) > 1 else []) + ([(d, b) for d in (1, 2) for b in bands] if by_duration else [])
    near = F.array(*(F.struct(F.lit(d).cast("long").alias("d"), F.lit(b).cast("long").alias("b")) for d, b in steps))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pair = ["kind", "size", "bucket", "band", "d", "b", "own", "other"]  # the cell that asks, how far on the other one is, a block of each

    def dealt_out(side: str, way: int, this: str, that: str) -> DataFrame:
        """Every block once for each block that it is compared with, under the pair's name: so a cell's work is as many tasks as pairs of blocks."""
        x = blocks.withColumn("s", F.explode(near)).where((F.col("bucket") >= 0) | (F.col("s.d") == 0))
        x = x.select("kind", "size", "bucket", "band", "s.d", "s.b", F.col("block").alias(this), F.col("rows").alias(side))
        x = x.withColumns({"to_bucket": F.col("bucket") + way * F.col("d"), "to_band": F.col("band") + way * F.col("b")})
        to = sizes.withColumnsRenamed({"bucket": "to_bucket", "band": "to_band"})
        x = x.join(to, ["kind", "size", "to_bucket", "to_band"]).withColumn(that, each)
        if way < 0:
            x = x.drop("bucket", "band").withColumnsRenamed({"to_bucket": "bucket", "to_band": "band"})
        own, other = F.col("own"), F.col("other")
        return x.where((F.col("d") != 0) | (F.col("b") != 0) | (own <= other)).select(*pair, side)

    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes can be much work
    met = dealt_out("asked", 1, "own", "other").repartition(tasks, *pair).join(dealt_out("rows", -1, "other", "own").hint("merge"), pair)
    same = (F.col("d") == 0) & (F.col("b") == 0) & (F.col("own") == F.col("other"))
    met = met.select("kind", "size", same.alias("same"), "asked", "rows")
    single, told = np.float32(limit), pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("difference", pa.float64()), ("flipped", pa.bool_())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, sizes, same = (batch.column(c).to_pylist() for c in ("kind", "size", "same"))
            for k, (kind_, size) in enumerate(zip(kinds, sizes)):
                many = 1 if kind_ == 1 else positions
                if size % many:
                    continue
                (xi, x), (yi, y) = (_unpacked(batch.column(c)[k].values, size) for c in ("asked", "rows"))
                by = None if black or white else _filter(x, y, limit)
                compared = (lambda p, q, n=many: _differences(p, q, n, black, white)) if by is None else (lambda p, q, n=many, by=by: _bounded(p, q, n, limit, by))
                step = max(1, (PAIRS if by is not None else 4 * PAIRS) // len(y))
                for i in range(0, len(x), step):
                    flipped = None
                    if by is not None and not config.flipped:
                        r, c, d = _near(x[i : i + step], y, many, by)
                    else:
                        difference = compared(x[i : i + step], y)
                        if config.flipped:  # mirroring either frame of a pair comes to the same
                            mirrored = compared(_mirrored(x[i : i + step], many), y)
                            flipped = ~np.isnan(mirrored) & (np.isnan(difference) | (mirrored < difference))
                            difference = np.where(flipped, mirrored, difference)
                        near = difference <= limit * (1 + 1e-6)
                        if np.count_nonzero(near) > near.size // 2:  # places of nearly all pairs would cost more than the comparison
                            r, c = (f.ravel() for f in np.broadcast_arrays(np.arange(len(difference))[:, None], np.arange(len(y))[None]))
                            d, flipped = difference.ravel(), None if flipped is None else flipped.ravel()
                        else:
                            r, c = np.nonzero(near)
                            d, flipped = difference[r, c], None if flipped is None else flipped[r, c]
                        d = d.astype(np.float64)
                    p, q = xi[i : i + step][r], yi[c]
                    keep = (d.astype(np.float32) <= single) & ((p < q) if same[k] else (p != q))
                    flip = np.zeros(len(p), dtype=bool) if flipped is None else flipped
                    rows_ = (np.minimum(p, q), np.maximum(p, q), d, flip)
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(v if keep.all() else v[keep]) for v in rows_], schema=told)

    return met.mapInArrow(compare, "a_id long, b_id long, difference double, flipped boolean")


def _unpacked(rows: pa.StructArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and frames of a block."""
    return rows.field("id").to_numpy(), np.frombuffer(b"".join(rows.field("bytes").to_pylist()), dtype=np.uint8).reshape(len(rows), size)


def bucket_blocks(rows: DataFrame, reach: int) -> DataFrame:
    """(own, x, y): arrays of rows that meet, a block of each bucket with every block of it and of the next ``reach`` ones; ``own`` if they are one block.

    Rows have a long ``bucket`` and an id. A pair of blocks is dealt to a task by its name.
    """
    zero, columns = F.lit(0).cast("long"), [c for c in rows.columns if c != "bucket"]
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt_out(side: str, way: int, this: str, that: str) -> DataFrame:
        x = blocks.select("bucket", F.col("block").alias(this), F.col("rows").alias(side), F.explode(F.sequence(zero, F.lit(reach).cast("long"))).alias("k"))
        x = x.withColumn("to", F.col("bucket") + way * F.col("k")).join(sizes.withColumnRenamed("bucket", "to"), "to")
        x = x.withColumn(that, F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("first", F.least("bucket", "to"))
        return x.where("k > 0 OR own <= other").select("first", "k", "own", "other", side).repartition(tasks, "first", "k", "own", "other")

    met = dealt_out("x", 1, "own", "other").join(dealt_out("y", -1, "other", "own").hint("merge"), ["first", "k", "own", "other"])
    return met.select((F.expr("k = 0 AND own = other")).alias("own"), "x", "y")


#: Rows of a block of codes, at least and at most.
CODES = (4096, 32_768)


def near_rows(asked: DataFrame, stored: DataFrame, max_bits: int, rows: int) -> DataFrame:
    """(a, b, distance): structs of all rows of asked and stored whose 64-bit codes (column h) differ in max_bits or fewer, compared block by block.

    If both are the same table a pair of rows comes once, either way round. ``rows`` says how many there are about:
    a side is cut into blocks, and every two blocks meet in a task.
    """
    same = asked is stored
    n = max(1, math.ceil(rows / min(max(CODES[0], rows // 32), CODES[1])))
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def dealt_out(df: DataFrame, side: str, this: str, that: str) -> DataFrame:
        x = df.where("h IS NOT NULL").groupBy(F.pmod(F.xxhash64(*df.columns), F.lit(n)).alias(this)).agg(F.collect_list(F.struct(*df.columns)).alias(side)).withColumn(that, all_)
        return (x.where("i <= j") if same else x).repartition(tasks, "i", "j")

    met = dealt_out(asked, "x", "i", "j").join(dealt_out(stored, "y", "j", "i").hint("merge"), ["i", "j"]).select((F.col("i") == F.col("j")).alias("own"), "x", "y")
    kind = lambda df: df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, own = batch.column("x")[k].values, batch.column("y")[k].values, same and batch.column("own")[k].as_py()
                p, q = (v.field("h").to_numpy().view(np.uint64) for v in (x, y))
                for j in range(0, len(q), TILE_ROWS):
                    other = q[j : j + TILE_ROWS]
                    step = max(1, TILE // len(other))
                    found = []
                    for i in range(0, len(p), step):
                        bits = np.bitwise_count(p[i : i + step, None] ^ other)
                        r, c = np.divmod(np.flatnonzero(bits <= max_bits), len(other))
                        if len(r):
                            found.append((r + i, c + j, bits[r, c]))
                    if not found:
                        continue
                    r, c, d = (np.concatenate(v) for v in zip(*found))
                    if own:
                        r, c, d = (v[r < c] for v in (r, c, d))
                    for f in range(0, len(r), PAIRS):
                        yield pa.RecordBatch.from_arrays([x.take(pa.array(r[f : f + PAIRS])), y.take(pa.array(c[f : f + PAIRS])), pa.array(d[f : f + PAIRS].astype(np.int32))], names=["a", "b", "distance"])

    return met.mapInArrow(compare, f"a {kind(asked)}, b {kind(stored)}, distance int")


def with_columns(found: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a_id, b_id, ...) with structs a and b of the items' columns."""
    side = F.struct("id", *(c for c in columns if c != "id"))
    out = found
    for s in ("a", "b"):
        out = out.join(items.select(F.col("id").alias(f"{s}_id"), side.alias(s)), f"{s}_id")
    return out.drop("a_id", "b_id")
