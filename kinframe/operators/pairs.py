"""Candidate pairs and their gates: exact blocking, seeded LSH, duration bands, pixel-mean bands, metrics."""

from __future__ import annotations

import random
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K
from kinframe.functions.phash import mirrored_hashes
from kinframe.operators import blocks

#: Keys that a hash asks for in one segment at the most, and what a key costs (it is shuffled) beside a comparison.
MOST_PROBES, PROBE_COST = 4096, 20.0
#: What a comparison costs where blocks of codes are compared whole, beside one of two rows that a key brings together.
WHOLE_COST = 1 / 32
LSH_TABLES, LSH_BITS = 10, 8


def _sided(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(side))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) structs with a.id < b.id that share the keys."""
    return _sided(left, "a", keys).join(_sided(right, "b", keys), keys).where("a.id < b.id").select("a", "b")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of max_bits + 1 pieces of a 64-bit hash: hashes within max_bits agree on one."""
    n = max_bits + 1
    return [(64 * i // n, 64 * (i + 1) // n - 64 * i // n) for i in range(n)]


def _segment(h: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) if bits < 64 else h


@dataclass(frozen=True)
class Index:
    """How 64-bit hashes are cut: (first bit, bits, radius) of each segment, and what a hash costs with it."""

    segments: tuple[tuple[int, int, int], ...]
    probes: int  # keys that a hash asks for
    met: float  # hashes that it meets, of ``rows`` that are spread evenly


@lru_cache(maxsize=256)
def index_plan(max_bits: int, rows: int) -> Index:
    """The cut for which probing and comparing cost least among ``rows`` hashes.

    Hashes within max_bits = m r + a bits (0 <= a < m) differ in r bits or fewer on one of the first a + 1 of m
    segments, or in r - 1 or fewer on one of the others: else they differed in more than max_bits. So longer
    segments take larger balls of keys, each of which holds fewer hashes; how long follows from the table's size.
    """
    best = None
    for m in range(1, min(max_bits + 1, 64) + 1):
        r, a = divmod(max_bits, m)
        cut = [(64 * i // m, 64 * (i + 1) // m - 64 * i // m, r if i <= a else r - 1) for i in range(m)]
        cut = [c for c in cut if c[2] >= 0]
        balls = [sum(comb(bits, k) for k in range(radius + 1)) for _, bits, radius in cut]
        if max(balls) > MOST_PROBES:
            continue
        found = Index(tuple(cut), sum(balls), sum(n * rows / 2.0**bits for n, (_, bits, _) in zip(balls, cut)))
        cost = found.probes * PROBE_COST + found.met
        if best is None or cost < best[0]:
            best = (cost, found)
    if best is None:
        raise ValueError(f"no segments of a 64-bit hash are selective for {max_bits} bits")
    return best[1]


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` of some bits."""
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)]


def near_codes(asked: DataFrame, stored: DataFrame, max_bits: int, index: Index, condition: Column | None = None, rows: int | None = None) -> DataFrame:
    """(a, b, distance): structs of rows of asked and stored whose 64-bit codes (column h) differ in max_bits or fewer; exact, each pair once.

    Where ``rows`` says how many are stored and the index would cost more than comparing them all, blocks of codes are
    compared whole (blocks.near_rows); a pair of one table then comes in the order of id.
    A stored row is shuffled once a segment, an asked row once for each key in the ball round its segment. A pair
    that meets in several segments is kept where its first one does, so nothing has to be made distinct.
    ``condition`` on a and b is tested where they meet.
    """
    if rows is not None and index.probes * PROBE_COST + index.met > rows * WHOLE_COST:
        met = blocks.near_rows(asked, stored, max_bits, rows)
        if asked is stored:
            first = F.col("a.id") < F.col("b.id")
            met = met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "distance")
        return met if condition is None else met.where(condition)
    keys = F.array(*(F.struct(F.lit(i).alias("seg"), _segment(F.col("h"), f, n).alias("val")) for i, (f, n, _) in enumerate(index.segments)))
    kept = stored.withColumn("k", F.explode(keys)).select("k.seg", "k.val", F.struct(*stored.columns).alias("b"))
    masks = [F.lit(_ball(n, r)) if n < 63 else F.array(F.lit(0).cast("long")) for _, n, r in index.segments]
    probe = asked.withColumn("k", F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _segment(F.col("h"), f, n).alias("val"), m.cast("array<long>").alias("m")) for i, ((f, n, _), m) in enumerate(zip(index.segments, masks))))))
    probe = probe.select(F.col("k.seg").alias("seg"), F.col("k.val").alias("own"), F.explode("k.m").alias("m"), F.struct(*asked.columns).alias("a"))
    probe = probe.select("seg", F.col("own").bitwiseXOR(F.col("m")).alias("val"), "a")
    x = F.col("a.h").bitwiseXOR(F.col("b.h"))
    # a side is larger than Spark thinks by its number of keys: never broadcast
    met = probe.join(kept.hint("merge"), ["seg", "val"]).withColumn("distance", F.bit_count(x)).where(F.col("distance") <= max_bits)
    if condition is not None:
        met = met.where(condition)
    first = F.array(*(F.bit_count(_segment(x, f, n)) <= r for f, n, r in index.segments))
    return met.where(F.array_position(first, True) == F.col("seg") + 1).select("a", "b", "distance")


def pigeonhole_pairs(items: DataFrame, max_bits: int, keep: list[str], rows: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs (a.id < b.id) whose hashes lo, hi differ in max_bits or fewer bits; exact.

    Tight thresholds meet by equal segments, loose ones by balls round longer segments (see index_plan): ``rows``
    says how many hashes there are (else they are counted). Rows without a hash meet nothing.
    """
    of = items.select(*dict.fromkeys(["id", "lo", "hi", *keep])).withColumn("h", K.whole_hash(F.col("lo"), F.col("hi"))).where("h IS NOT NULL")
    rows = items.count() if rows is None else rows
    found = near_codes(of, of, max_bits, index_plan(max_bits, rows), F.col("a.id") < F.col("b.id"), rows)
    side = lambda s: F.struct(*(f"{s}.{c}" for c in of.columns if c != "h")).alias(s)
    return found.select(side("a"), side("b"), "distance")


def _grid(rows: DataFrame, buckets: int) -> DataFrame:
    """(a, b) of all pairs, a.id < b.id: a row goes to the cells of one row and one column of a triangle of cells."""
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    wide = F.sequence(F.lit(0), F.lit(buckets - 1))
    a = rows.withColumn("q", F.explode(wide)).withColumnRenamed("g", "r")
    b = rows.withColumn("r", F.explode(wide)).withColumnRenamed("g", "q")
    return _joined(a, b, ["r", "q"])


#: Rows of a block of rows that share a key, and blocks of a key at the most (larger keys have larger blocks).
KEY_BLOCK, KEY_CUTS = 2048, 32


def keyed_pairs(items: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """(a, b) of all pairs with a.id < b.id that share the keys, with id and ``keep``.

    Rows of a key are cut into blocks by id, and a row goes to the cells of its block and each block after and before
    it: a few keys are many tasks, a join holds a block's rows at a time, and only the columns named are shuffled.
    """
    rows = items.select(*dict.fromkeys([*keys, "id", *keep])).dropna(subset=keys)
    cuts = F.percentile_approx("id", [k / KEY_CUTS for k in range(1, KEY_CUTS)])
    cut = rows.groupBy(*keys).agg(F.least(F.ceil(F.count(F.lit(1)) / KEY_BLOCK), F.lit(KEY_CUTS)).cast("int").alias("blocks"), cuts.alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c <= F.col("id")))
    dealt = rows.join(cut, keys).withColumn("block", F.floor(place * F.col("blocks") / KEY_CUTS).cast("int"))
    tasks, names = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), [c for c in rows.columns if c not in keys]
    side = lambda s, own, other, first, last: dealt.select(*keys, F.struct(*names).alias(s), F.col("block").alias(own), F.explode(F.sequence(first, last)).alias(other)).repartition(tasks, *keys, "q", "r")
    after, before = side("a", "q", "r", F.col("block"), F.col("blocks") - 1), side("b", "r", "q", F.lit(0), F.col("block"))
    return after.join(before.hint("merge"), [*keys, "q", "r"]).where("q < r OR a.id < b.id").select("a", "b")


def theta_pairs(items: DataFrame, keep: list[str], buckets: int = 16) -> DataFrame:
    """(a, b, distance) of all pairs, for distances no blocking helps with: rows meet in buckets x buckets cells.

    Each row goes to one row and one column of a grid of cells, so a task has a cell's rows only; there is no
    broadcast of a side. The work is that of all pairs.
    """
    pairs = _grid(items.select(*dict.fromkeys(["id", "lo", "hi", *keep])), buckets)
    return pairs.withColumn("distance", K.hamming(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")))


def lsh_tables(seed: int = 42, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> list[list[int]]:
    rng = random.Random(seed)
    return [rng.sample(range(64), bits) for _ in range(tables)]


def lsh_pairs(items: DataFrame, max_bits: int, keep: list[str], tables: list[list[int]] | None = None) -> DataFrame:
    """(a, b, distance): the pairs within max_bits that some table's key finds, itself or with one bit flipped."""
    tables = tables or lsh_tables()
    rows = items.select(*dict.fromkeys(["id", "lo", "hi", *keep]))
    stored = rows.withColumn("k", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), K.lsh_key(bits, F.col("lo"), F.col("hi")).alias("key")) for t, bits in enumerate(tables)))))
    stored = stored.select(*rows.columns, "k.t", "k.key")
    probes = stored.withColumn("key", F.explode(F.array("key", *(F.col("key").bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(len(tables[0]))))))
    pairs = _joined(probes, stored, ["t", "key"])
    pairs = pairs.withColumn("distance", K.hamming(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))).where(F.col("distance") <= max_bits)
    return pairs.withColumns({"_a": F.col("a.id"), "_b": F.col("b.id")}).dropDuplicates(["_a", "_b"]).drop("_a", "_b")


def duration_pairs(items: DataFrame, config: ScanConfig, keep: list[str]) -> DataFrame:
    """(a, b) of equal media kind whose durations are within both tolerances (images: all pairs).

    Rows meet in buckets that are a tolerance wide, each with its own and the next two, so a row is repeated three
    times whatever its duration. Images have none and meet in a grid of cells, like all pairs.
    """
    rows = items.select(*dict.fromkeys(["id", "duration_s", "is_image", *keep]))
    video = rows.where("NOT is_image").withColumn("bucket", blocks.duration_bucket(F.col("duration_s"), config).cast("long"))
    later = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("bucket") + k).alias("to")) for k in range(3)))
    probes = _sided(video.withColumn("s", F.explode(later)).select("*", "s.k", F.col("s.to").alias("bucket_")).drop("s", "bucket").withColumnRenamed("bucket_", "bucket"), "x", ["bucket", "k"])
    met = probes.join(_sided(video, "y", ["bucket"]), "bucket").where("x.id <> y.id AND (k > 0 OR x.id < y.id)")
    names = rows.columns
    side = lambda first: F.when(F.col("x.id") < F.col("y.id"), F.struct(*(f"{first}.{c}" for c in names))).otherwise(F.struct(*(f"{'y' if first == 'x' else 'x'}.{c}" for c in names)))
    pairs = met.select(side("x").alias("a"), side("y").alias("b")).where(duration_gate(F.col("a.duration_s"), F.col("b.duration_s"), config))
    return pairs.unionByName(_grid(rows.where("is_image"), 16))


def mean_band_pairs(items: DataFrame, limit: float, keep: list[str]) -> DataFrame:
    """(a, b) of pairs whose frames' mean levels differ by no more than limit * 256: all that can match do.

    The mean of absolute differences is never under the difference of means, so rows meet in bands of that
    width, each with its own and the next one.
    """
    width = max(limit * 256.0, 1e-6) + 1e-9
    mean = K.sum_of(F.transform("frame", lambda x: x.cast("long"))) / F.size("frame")
    rows = items.select(*dict.fromkeys(["id", "frame", *keep])).withColumn("mean", mean)
    stored = rows.withColumn("band", F.floor(F.col("mean") / width))
    probes = stored.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    return _joined(probes, stored, ["band"]).where(F.abs(F.col("a.mean") - F.col("b.mean")) <= width)


# --- gates -------------------------------------------------------------------------------------------------


def duration_gate(a: Column, b: Column, config: ScanConfig) -> Column:
    tol = lambda d: K.duration_tolerance(d, config.duration_percent, config.duration_min_s, config.duration_max_s)
    return F.abs(a - b) <= F.least(tol(a), tol(b))


def size_gate(a: Column, b: Column, percent: float) -> Column:
    """b's size lies in a band round a's, which comes first; both ends are cut to whole bytes."""
    if percent <= 0:
        return F.lit(True)
    share = percent / 100.0
    return b.between((a * (1.0 - share)).cast("long"), (a * (1.0 + share)).cast("long"))


def resolution_gate(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    """Neither side is under half (whole) of the other, in width or height; unknown sizes pass."""
    half = lambda x, y: F.least(x, y) >= F.floor(F.greatest(x, y) / 2)
    known = F.coalesce((wa > 0) & (ha > 0) & (wb > 0) & (hb > 0), F.lit(False))
    return ~known | (half(wa, wb) & half(ha, hb))


def folder_gate(a: Column, b: Column, mode: str, depth: int) -> Column:
    if mode == "any":
        return F.lit(True)
    same = K.last_segments(a, depth) == K.last_segments(b, depth)
    return same if mode == "same" else ~same


def hard_link_gate(a: Column, b: Column, on: bool) -> Column:
    return (a != b) if on else F.lit(True)


QUICK_BITS = 32


def quick_gate(distance: Column, most: int = QUICK_BITS) -> Column:
    """A hash distance over ``most`` rejects; a missing one passes."""
    return F.coalesce(distance <= most, F.lit(True))


def quick_gate_positions(a: Column, b: Column, first: Column, most: int = QUICK_BITS) -> Column:
    """Arrays of hashes, one a position: any distance over ``most`` rejects, positions that lack a hash are passed over.

    Where a side has no array, or they differ in length, the distance ``first`` of the first positions decides.
    """
    each = F.forall(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), lambda d: F.coalesce(d <= most, F.lit(True)))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), each).otherwise(quick_gate(first, most))


def gates(config: ScanConfig, positions: bool = False) -> dict[str, Column]:
    """Every gate between a (the earlier row) and b, by name, cheapest first; with ``positions`` both have hashes, one a position."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    first = K.hamming(a("lo"), a("hi"), b("lo"), b("hi"))
    return {
        "kind": a("is_image") == b("is_image"),
        "quick": quick_gate_positions(a("hashes"), b("hashes"), first) if positions else quick_gate(first),
        "duration": a("is_image") | duration_gate(a("duration_s"), b("duration_s"), config),
        "size": size_gate(a("size"), b("size"), config.size_percent),
        "resolution": resolution_gate(a("width"), a("height"), b("width"), b("height")) if config.resolution_gate else F.lit(True),
        "folder": folder_gate(a("folder"), b("folder"), config.folder_mode, config.folder_depth),
        "hard_link": hard_link_gate(a("file_id"), b("file_id"), config.skip_hard_links),
    }


def position_columns(items: DataFrame) -> list[str]:
    """The columns of items that hold a value for each position."""
    return [c for c in ("hashes", "frames") if c in items.columns]


def hash_columns(items: DataFrame) -> list[str]:
    return [c for c in ("hashes",) if c in items.columns]


def metric(config: ScanConfig, side: int) -> tuple[Column, Column]:
    """(difference, flipped) of a pair by the configured metric; the mirrored left frame counts if it alone is better."""
    a, b = F.col("a.frame"), F.col("b.frame")

    def of(x: Column) -> Column:
        if config.ignore_black or config.ignore_white:
            return K.masked_difference(x, b, config.ignore_black, config.ignore_white).cast("double")
        return K.pixel_difference(x, b)

    plain = of(a)
    if not config.flipped:
        return plain, F.lit(False)
    mirrored = of(K.flipped(a, side))
    better = ~F.isnan(mirrored) & (F.isnan(plain) | (mirrored < plain))
    return F.when(better, mirrored).otherwise(plain), better


def passed(pairs: DataFrame, config: ScanConfig) -> DataFrame:
    """Pairs (a, b, ...) that pass every gate."""
    for c in gates(config, "hashes" in pairs.schema["a"].dataType.names).values():
        pairs = pairs.where(c)
    return pairs


def matches(pairs: DataFrame, config: ScanConfig, side: int = 8) -> DataFrame:
    """(a, b, difference, flipped): pairs that pass every gate and whose difference is within the limit."""
    kept = passed(pairs, config)
    if config.use_phash:
        d = K.hamming(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))
        return kept.select("a", "b", (d / F.lit(64.0)).alias("difference"), F.lit(False).alias("flipped")).where(d <= config.max_bits)
    diff, flip = metric(config, side)
    out = kept.select("a", "b", diff.alias("difference"), flip.alias("flipped"))
    return out.where(~F.isnan("difference") & (F.col("difference").cast("float") <= F.lit(config.limit).cast("float")))


PAIR_COLUMNS = ["lo", "hi", "duration_s", "size", "width", "height", "folder", "file_id", "is_image", "path"]


def _sides() -> list[Column]:
    """a and b with the columns that every way of matching gives."""
    return [F.struct(f"{s}.id", *(f"{s}.{c}" for c in PAIR_COLUMNS)).alias(s) for s in ("a", "b")]


def candidates(items: DataFrame, config: ScanConfig) -> DataFrame:
    """Pairs (a, b) of the configured (or best) blocking; every one of them holds all pairs that can match.

    Only ids and what blocking needs are shuffled; the other columns are fetched for the pairs that are left.
    """
    how = config.blocking
    if how == "auto":
        how = "pigeonhole" if config.use_phash else "frames"
    if how == "frames":
        return blocks.with_columns(blocks.frame_matches(items, config), items, [*PAIR_COLUMNS, *hash_columns(items)])
    if how == "pigeonhole":
        found = pigeonhole_pairs(items, config.max_bits, [])
    elif how == "lsh":
        found = lsh_pairs(items, config.max_bits, [], lsh_tables(config.seed))
    elif how == "duration":
        found = duration_pairs(items, config, [])
    elif how == "mean":
        found = mean_band_pairs(items, config.limit, [])
    else:
        found = theta_pairs(items, [])
    found = found.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    return blocks.with_columns(found, items, [*PAIR_COLUMNS, "frame", *position_columns(items)])


def all_matches(items: DataFrame, config: ScanConfig, side: int = 8) -> DataFrame:
    """(a, b, difference, flipped) of all pairs of items that the configured scan matches.

    Images are compared by their frames in every mode. Videos are compared by frames too, or by hashes with
    use_phash: with ``hashes`` every position must be within the bits and the mean counts, else lo and hi decide.
    A video without a hash is similar to nothing there, and a pair with unequal numbers of positions neither. With
    flipped, ``flipped_hashes`` (made of binary 32 x 32 ``frames`` if they aren't there) of a count too.
    """
    if "hashes" in items.columns:  # the first position's is the one that the quick gate tests
        first = F.get("hashes", F.lit(0))
        items = items.withColumns({"lo": first.bitwiseAND(F.lit(0xFFFFFFFF)), "hi": F.shiftrightunsigned(first, 32)})
    by_frame, by_hash = items, None
    if config.use_phash and config.flipped and "flipped_hashes" not in items.columns and dict(items.dtypes).get("frames") == "array<binary>":
        items = items.withColumn("flipped_hashes", mirrored_hashes("frames"))
    if config.use_phash:
        by_frame, by_hash = items.where("is_image"), items.where("NOT is_image")
    if config.blocking not in ("auto", "frames", "pigeonhole", "lsh"):
        found = matches(candidates(by_frame, config), replace(config, use_phash=False), side)
    else:
        found = passed(blocks.with_columns(blocks.frame_matches(by_frame, config), by_frame, [*PAIR_COLUMNS, *hash_columns(items)]), config).select(*_sides(), "difference", "flipped")
    if by_hash is None:
        return found
    return found.unionByName(hash_matches(by_hash, config))


def hash_matches(videos: DataFrame, config: ScanConfig) -> DataFrame:
    """(a, b, difference, flipped) of videos by their perceptual hashes; with config.flipped also by ``flipped_hashes`` of a, where there are."""
    several, rows = "hashes" in videos.columns, videos
    whole = K.whole_hash(F.col("lo"), F.col("hi"))
    rows = rows.withColumn("own", F.col("hashes") if several else F.array(whole))
    search = {"pigeonhole": pigeonhole_pairs, "lsh": lambda r, n, k: lsh_pairs(r, n, k, lsh_tables(config.seed))}.get(config.blocking, pigeonhole_pairs)
    found = search(rows.where("lo IS NOT NULL AND hi IS NOT NULL"), config.max_bits, []).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    sides = ["own"]
    if config.flipped and "flipped_hashes" in videos.columns:
        mirrored = rows.withColumns({"lo": F.get("flipped_hashes", F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)), "hi": F.shiftrightunsigned(F.get("flipped_hashes", F.lit(0)), 32)})
        # a mirrored row meets all others under an id beside its own: 2 id (+ 1 if mirrored)
        both = rows.withColumn("id", 2 * F.col("id")).unionByName(mirrored.withColumn("id", 2 * F.col("id") + 1)).where("lo IS NOT NULL AND hi IS NOT NULL")
        more = search(both, config.max_bits, []).where("a.id % 2 <> b.id % 2").select(F.shiftright("a.id", 1).alias("x"), F.shiftright("b.id", 1).alias("y")).where("x <> y")
        found = found.unionByName(more.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))).distinct()
        sides.append("flipped_hashes")
    pairs = passed(blocks.with_columns(found, rows, [*PAIR_COLUMNS, *sides, *hash_columns(videos)]), config)
    plain = match_positions(F.col("a.own"), F.col("b.own"), config.max_bits)
    mirrored = match_positions(F.col("a.flipped_hashes"), F.col("b.own"), config.max_bits) if len(sides) > 1 else F.lit(None).cast("double")
    flip = F.coalesce(mirrored > plain, mirrored.isNotNull() & plain.isNull())
    out = pairs.select(*_sides(), F.when(flip, mirrored).otherwise(plain).alias("similarity"), flip.alias("flipped"))
    return out.where("similarity IS NOT NULL").select("a", "b", (1 - F.col("similarity")).alias("difference"), "flipped")


def match_positions(a: Column, b: Column, max_bits: int) -> Column:
    """Similarity of two arrays of hashes (a position each): null unless every position is within max_bits."""
    d = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    ok = (F.size(a) == F.size(b)) & F.forall(d, lambda x: x.isNotNull() & (x <= max_bits))
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + (1.0 - x / 64.0)) / F.size(d)
    return F.when(F.coalesce(ok, F.lit(False)), mean)
