"""Clips inside sources: a range join on duration, a sliding Hamming window over fingerprints, assignment, a visual gate."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.functions import kernels as K

from . import filters, pairs

#: A clip is shorter than this share of its source.
MAX_RATIO = 0.95
#: Differing bits of two values in a row (64 bits) up to which seeds are looked for; clips that need more compare by duration alone.
SEED_BITS = 20


def bit_budget(n: Column, min_similarity: float) -> Column:
    """Bits that may differ in a window of n values: what min_similarity leaves, cut to whole bits after single-precision arithmetic."""
    left = F.lit(float(np.float32(1.0) - np.float32(min_similarity))).cast("float")
    return F.floor((left * (n * 32).cast("float")).cast("float")).cast("int")


def _bits_at(shorter: Column, longer: Column, n: Column, off: Column) -> Column:
    return F.aggregate(F.zip_with(shorter, F.slice(longer, off + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def best_window(shorter: Column, longer: Column, min_similarity: float, offsets: Column) -> Column:
    """struct(similarity, offset): the best alignment of the shorter fingerprint in the longer one at one of ``offsets``, the first of equals; null if none is within the budget."""
    n = F.size(shorter)
    each = F.transform(offsets, lambda off: F.struct((-_bits_at(shorter, longer, n, off)).alias("s"), (-off).alias("o")))
    budget = bit_budget(n, min_similarity)
    best = F.array_max(F.filter(each, lambda x: -x["s"] <= budget))
    return F.when(best.isNotNull(), F.struct((1.0 - (-best["s"]) / (n * 32)).alias("similarity"), (-best["o"]).alias("offset")))


def sliding_match(shorter: Column, longer: Column, min_similarity: float) -> Column:
    """best_window() at every offset; null if a side is empty or the shorter one is not shorter or equal.

    Fingerprints are arrays of 32-bit values held as longs.
    """
    n, m = F.size(shorter), F.size(longer)
    return F.when((n > 0) & (m >= n), best_window(shorter, longer, min_similarity, F.sequence(F.lit(0), m - n)))


def eligible(videos: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """Videos that take part: a fingerprint of two blocks or more that isn't silent, no silence flag, no image, not in ``grouped`` (id)."""
    rows = videos.where((F.size("fp") >= 2) & ~filters.silent(F.col("fp")))
    if "is_image" in videos.columns:
        rows = rows.where(~F.coalesce("is_image", F.lit(False)))
    if "flags" in videos.columns:
        rows = rows.where(~F.coalesce(K.has_any(F.col("flags"), K.FLAGS["silent_audio"]), F.lit(False)))
    return rows if grouped is None else rows.join(grouped.select("id").distinct(), "id", "left_anti")


def clip_candidates(videos: DataFrame, min_ratio: float) -> DataFrame:
    """(s, c) structs: a source and a shorter video whose duration is from min_ratio to under MAX_RATIO of it.

    ``videos`` has id, idx (place in order of falling duration), duration_s and fp. Both meet in buckets of the
    logarithm of duration to base 1/min_ratio, so a pair lies in one or two neighbours: an equi-join.
    """
    step = math.log(1.0 / min_ratio)
    rows = videos.where((F.size("fp") >= 2) & (F.col("duration_s") >= 1)).withColumn("bucket", F.floor(F.log("duration_s") / step).cast("long"))
    s = rows.withColumn("k", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).select("k", F.struct("id", "idx", "duration_s", "fp").alias("s"))
    c = rows.select(F.col("bucket").alias("k"), F.struct("id", "idx", "duration_s", "fp").alias("c"))
    ratio = F.col("c.duration_s") / F.col("s.duration_s")
    return s.join(c, "k").where((F.col("s.id") != F.col("c.id")) & (ratio >= min_ratio) & (ratio < MAX_RATIO) & (F.size("c.fp") < F.size("s.fp"))).select("s", "c")


def _runs(rows: DataFrame, step: int) -> DataFrame:
    """rows with h, first, last: 64-bit codes of two values in a row, at each ``step``-th place; equal codes in a row are one.

    So a silent or constant stretch is one row, however long it is.
    """
    codes = rows.withColumn("c", F.transform(F.sequence(F.lit(0), F.size("fp") - 2, F.lit(step)), lambda i: F.get("fp", i).bitwiseOR(F.shiftleft(F.get("fp", i + 1), 32)))).drop("fp")
    begins = F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: (i == 0) | (F.get("c", i) != F.get("c", i - 1)))
    codes = codes.withColumn("b", begins)
    each = F.transform("b", lambda i, k: F.struct(F.get("c", i).alias("h"), (i * step).alias("first"), ((F.coalesce(F.get("b", k + 1), F.size("c")) - 1) * step).alias("last")))
    codes = codes.withColumn("e", F.explode(each))
    return codes.select(*(c for c in rows.columns if c != "fp"), "e.h", "e.first", "e.last")


def seed_bits(n: Column, min_similarity: float) -> Column:
    """Bits within which some two neighbouring values of a clip of n values are, if the clip is within its budget: an equal share of it."""
    return F.floor(bit_budget(n, min_similarity) / F.floor(n / 2)).cast("int")


def seeded_offsets(clips: DataFrame, videos: DataFrame, min_ratio: float, min_similarity: float, index: pairs.Index, bits: int, places: int | None = None) -> DataFrame:
    """(source_id, clip_id, offsets): the offsets at which two neighbouring values of a clip are near those of a source.

    A clip of n values is within its budget of bits somewhere only if one of its n div 2 pairs of values is within
    seed_bits(). These 64-bit codes meet in a multi-index (pairs.near_codes); of the fingerprints nothing else is
    shuffled. Duration, length and place are tested where codes meet.
    """
    need = lambda df: df.select("id", "duration_s", F.size("fp").alias("n"), "fp")
    stored = _runs(need(videos), 1)
    asked = _runs(need(clips).withColumn("share", seed_bits(F.col("n"), min_similarity)), 2)
    ratio = F.col("a.duration_s") / F.col("b.duration_s")
    low, high = F.col("b.first") - F.col("a.last"), F.col("b.last") - F.col("a.first")
    fits = (F.col("a.id") != F.col("b.id")) & (ratio >= min_ratio) & (ratio < MAX_RATIO) & (F.col("a.n") < F.col("b.n")) & (high >= 0) & (low <= F.col("b.n") - F.col("a.n"))
    met = pairs.near_codes(asked, stored, bits, index, fits, places).where(F.col("distance") <= F.col("a.share"))
    spans = met.select(F.col("b.id").alias("source_id"), F.col("a.id").alias("clip_id"), F.greatest(low, F.lit(0)).alias("lo"), F.least(high, F.col("b.n") - F.col("a.n")).alias("hi"))
    each = spans.distinct().select("source_id", "clip_id", F.explode(F.sequence("lo", "hi")).alias("o"))
    return each.groupBy("source_id", "clip_id").agg(F.array_sort(F.collect_set("o")).alias("offsets"))  # no more than the source has places


def clip_matches(videos: DataFrame, min_ratio: float = 0.1, min_similarity: float = 0.8, most_bits: int = SEED_BITS) -> DataFrame:
    """(source_id, source_idx, clip_id, clip_idx, similarity, offset_s) of every clip in every source that holds it.

    Seeds say which offsets can match (see seeded_offsets; exact), and only pairs with a seed fetch their
    fingerprints. Clips for which seeds of ``most_bits`` bits aren't enough (at 0.8: none; at looser similarities
    first the shortest) are compared with all sources of fitting durations.
    """
    rows = videos.where((F.size("fp") >= 2) & (F.col("duration_s") >= 1))
    share = seed_bits(F.size("fp"), min_similarity)
    tight = share <= most_bits
    stats = rows.agg(F.max(F.when(tight, share)).alias("bits"), F.sum(F.size("fp")).alias("places"), F.max(~tight).alias("loose")).first()
    out = []
    if stats["bits"] is not None:
        seeds = seeded_offsets(rows.where(tight), rows, min_ratio, min_similarity, pairs.index_plan(stats["bits"], stats["places"]), stats["bits"], stats["places"])
        whole = lambda s: rows.select(F.col("id").alias("source_id" if s == "s" else "clip_id"), F.struct("id", "idx", "fp").alias(s))
        seen = seeds.join(whole("s"), "source_id").join(whole("c"), "clip_id")
        out.append(seen.select("s", "c", best_window(F.col("c.fp"), F.col("s.fp"), min_similarity, F.col("offsets")).alias("m")))
    if stats["loose"] or not out:
        short = clip_candidates(rows, min_ratio).where(seed_bits(F.size("c.fp"), min_similarity) > most_bits)
        part = lambda s: F.struct(f"{s}.id", f"{s}.idx", f"{s}.fp").alias(s)
        out.append(short.select(part("s"), part("c"), sliding_match(F.col("c.fp"), F.col("s.fp"), min_similarity).alias("m")))
    found = (out[0] if len(out) == 1 else out[0].unionByName(out[1])).where("m is not null")
    return found.select(F.col("s.id").alias("source_id"), F.col("s.idx").alias("source_idx"), F.col("c.id").alias("clip_id"), F.col("c.idx").alias("clip_idx"), "m.similarity", F.col("m.offset").alias("offset_s"))


def by_duration(videos: DataFrame) -> DataFrame:
    """Adds idx: place in the order of falling duration, then id."""
    from .ranking import global_rank

    return global_rank(videos, [F.col("duration_s").desc(), F.col("id")], "idx")


def assign_clips(matches: DataFrame) -> DataFrame:
    """Each clip goes to its longest source (lowest source_idx); group_id is the source's id."""
    w = Window.partitionBy("clip_id").orderBy("source_idx", "source_id")
    first = matches.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.withColumn("group_id", F.col("source_id"))


def clip_items(assigned: DataFrame) -> DataFrame:
    """(group_id, id, similarity, is_clip, offset_s): each source once with similarity 100, then its clips."""
    sources = assigned.select("group_id", F.col("source_id").alias("id"), F.lit(100.0).alias("similarity"), F.lit(False).alias("is_clip"), F.lit(0).alias("offset_s")).distinct()
    clips = assigned.select("group_id", F.col("clip_id").alias("id"), (F.col("similarity") * 100).alias("similarity"), F.lit(True).alias("is_clip"), "offset_s")
    return sources.unionByName(clips)


def gate_times(duration: Column) -> Column:
    """Places of a clip, in seconds, at which its frames are compared with the source's."""
    many = F.array(*(duration * x for x in (0.25, 0.5, 0.75)))
    return F.when(duration >= 9, many).when(duration >= 3, F.array(duration * 0.33, duration * 0.66)).otherwise(F.array(duration * 0.5))


def frame_similarities(assigned: DataFrame, videos: DataFrame, frames: DataFrame, use_phash: bool = False) -> DataFrame:
    """(source_id, clip_id, similarity) at each place of gate_times(), for visual_gate().

    ``videos`` has id and duration_s; ``frames`` id, at_s (seconds, met to the millisecond) and frame, or phash
    (64 bits) with use_phash. Places in the last tenth of a second of either file are left out.
    """
    ms = lambda c: F.round(c * 1000).cast("long")
    value = "phash" if use_phash else "frame"
    length = videos.select("id", "duration_s")
    at = assigned.select("source_id", "clip_id", "offset_s").join(length.select(F.col("id").alias("source_id"), F.col("duration_s").alias("long_s")), "source_id")
    at = at.join(length.select(F.col("id").alias("clip_id"), F.col("duration_s").alias("short_s")), "clip_id").withColumn("t", F.explode(gate_times(F.col("short_s"))))
    at = at.where((F.col("offset_s") + F.col("t") < F.col("long_s") - 0.1) & (F.col("t") < F.col("short_s") - 0.1))
    at = at.select("source_id", "clip_id", ms(F.col("offset_s") + F.col("t")).alias("x_ms"), ms(F.col("t")).alias("y_ms"))
    x = frames.select(F.col("id").alias("source_id"), ms(F.col("at_s")).alias("x_ms"), F.col(value).alias("x")).dropDuplicates(["source_id", "x_ms"])
    y = frames.select(F.col("id").alias("clip_id"), ms(F.col("at_s")).alias("y_ms"), F.col(value).alias("y")).dropDuplicates(["clip_id", "y_ms"])
    alike = 1.0 - F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) / 64.0 if use_phash else 1.0 - K.pixel_difference(F.col("x"), F.col("y"))
    return at.join(x, ["source_id", "x_ms"], "left").join(y, ["clip_id", "y_ms"], "left").select("source_id", "clip_id", alike.alias("similarity"))


def visual_gate(assigned: DataFrame, similarities: DataFrame, threshold: float) -> DataFrame:
    """Assignments whose mean frame similarity reaches the threshold, or of which nothing could be compared.

    ``similarities`` has source_id, clip_id and similarity (null where a frame is missing or out of range).
    """
    mean = similarities.groupBy("source_id", "clip_id").agg(F.avg("similarity").alias("visual"))
    return assigned.join(mean, ["source_id", "clip_id"], "left").where(F.coalesce(F.col("visual") >= threshold, F.lit(True)))


def majority_vote(rows: DataFrame, keys: list[str], value: str = "fp") -> DataFrame:
    """One 32-bit value a key: the bits that more than half of its rows have."""
    ones = [F.sum(F.shiftright(F.col(value), b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(32)]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ones)
    vote = F.lit(0).cast("long")
    for b in range(32):
        vote = vote + F.when(F.col(f"b{b}") >= F.floor(F.col("n") / 2) + 1, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return counted.select(*keys, vote.alias(value))
