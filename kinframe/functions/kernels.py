"""Scalar functions on columns: frames, hashes, tolerances, paths, formats. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------------------------
#: Flags of a catalog row.
FLAGS = {"image": 1, "manually_excluded": 2, "thumbnail_error": 4, "metadata_error": 8, "too_dark": 16, "no_audio": 32, "audio_error": 64, "silent_audio": 128, "reparse_point": 256, "reparse_checked": 512}
ALL_ERRORS = FLAGS["thumbnail_error"] | FLAGS["metadata_error"] | FLAGS["too_dark"]
#: Pixels at or under DARK count as black, at or over WHITE as white; a frame needs less than DARK_SHARE dark ones.
DARK, WHITE, DARK_SHARE = 0x20, 0xF0, 80.0
HDR_RANKS = {"Dolby Vision": 4, "HDR10+": 3, "HDR10": 2, "HLG": 1}
VIDEO_EXTENSIONS = (".mp4", ".wmv", ".avi", ".mkv", ".flv", ".mov", ".mpg", ".mpeg", ".m4v", ".asf", ".f4v", ".webm", ".divx", ".m2t", ".m2ts", ".vob", ".ts", ".rmvb", ".rm")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic", ".heif")
# -----------------------------------------------------------------------------------------------------------


def sum_of(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)


def pixel_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two frames (int arrays), as a share of 256; exact."""
    return sum_of(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long"))) / F.size(a) / F.lit(256.0)


def masked_difference(a: Column, b: Column, ignore_black: bool = True, ignore_white: bool = True) -> Column:
    """The same over pixels that are neither black nor white in either frame, single precision; NaN if none is left."""

    def keep(x: Column) -> Column:
        ok = F.lit(True)
        if ignore_black:
            ok = ok & (x["a"] > DARK) & (x["b"] > DARK)
        if ignore_white:
            ok = ok & (x["a"] < WHITE) & (x["b"] < WHITE)
        return ok

    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), keep)
    total = F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + F.abs(x["a"] - x["b"]))
    share = (total.cast("float") / F.size(both).cast("float")).cast("float") / F.lit(256.0).cast("float")
    return F.when(F.size(both) == 0, F.lit(float("nan")).cast("float")).otherwise(share.cast("float"))


def flipped(frame: Column, side: int) -> Column:
    """A square frame mirrored left to right."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.reverse(F.slice(frame, r * side + 1, side))))


def is_dark(frame: Column) -> Column:
    """A frame of which DARK_SHARE percent or more is black."""
    dark = F.size(F.filter(frame, lambda x: x <= DARK))
    return dark.cast("double") / F.size(frame) * 100.0 >= DARK_SHARE


def median_of_64(values: Column) -> Column:
    """Mean of the two middle values."""
    ordered = F.array_sort(values)
    return (F.get(ordered, F.lit(31)).cast("double") + F.get(ordered, F.lit(32)).cast("double")) / 2


def half_hash(values: Column, median: Column, half: int) -> Column:
    """32 bits of a 64-value array, bit i set where the value is over the median; half 0 is the low one."""
    bit = lambda x, i: F.when(x.cast("double") > median, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return sum_of(F.transform(F.slice(values, 1 + 32 * half, 32), bit))


def hamming(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Differing bits of two hashes given as 32-bit halves."""
    return F.bit_count(lo_a.bitwiseXOR(lo_b)) + F.bit_count(hi_a.bitwiseXOR(hi_b))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def whole_hash(lo: Column, hi: Column) -> Column:
    """Both halves as one signed 64-bit number."""
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def phash_match(distance: Column, percent: float, strict: bool = True) -> Column:
    """distance within the bits that a share ``percent`` (0-1) leaves: rounded down, or to even if not strict."""
    if not 0 <= percent <= 1:
        raise ValueError("percent must be from 0 to 1")
    left = F.lit((1.0 - percent) * 64)
    return distance <= (F.floor(left) if strict else F.bround(left))


def lsh_key(bits_of: list[int], lo: Column, hi: Column) -> Column:
    """The selected bits of a hash, the first one lowest."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits_of):
        one = F.shiftright(lo if b < 32 else hi, b % 32).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(one, k))
    return out


def duration_tolerance(duration: Column, percent: float, least: float, most: float) -> Column:
    """Seconds that durations may differ: a share of the duration between least and most (0: no bound); percent 0: the larger bound."""
    if percent <= 0:
        return F.lit(float(max(least, most)))
    out = duration * F.lit(percent / 100.0)
    if least > 0:
        out = F.greatest(out, F.lit(float(least)))
    if most > 0:
        out = F.least(out, F.lit(float(most)))
    return out


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) == mask


def with_flag(flags: Column, mask: int, on: bool = True) -> Column:
    return flags.bitwiseOR(mask) if on else flags.bitwiseAND(~mask)


def glob_to_like(pattern: str) -> str:
    """``*`` and ``?`` of a simple expression as LIKE's wildcards, all else literal."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def glob(c: Column, pattern: str) -> Column:
    """Case-insensitive simple expression over the whole string."""
    return F.lower(c).like(glob_to_like(pattern.lower()))


def size_mb(size: Column) -> Column:
    """Whole megabytes by way of single precision, rounded towards zero."""
    return (size.cast("float") / F.lit(1024.0).cast("float") / F.lit(1024.0).cast("float")).cast("float").cast("long")


def hdr_format(transfer: Column, side_data: Column) -> Column:
    """HDR kind of a stream from its transfer function and the types of its side data; empty if none."""
    side, how = F.coalesce(F.lower(side_data), F.lit("")), F.coalesce(F.lower(transfer), F.lit(""))
    pq = F.when(side.contains("dovi"), "Dolby Vision").when(side.contains("smpte2094"), "HDR10+").otherwise("HDR10")
    return F.when(how == "arib-std-b67", "HLG").when(how == "smpte2084", pq).otherwise("")


def hdr_rank(name: Column) -> Column:
    out = F.lit(0)
    for k, v in HDR_RANKS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def human_bytes(size: Column) -> Column:
    """One decimal of the largest unit that leaves at least one; zero is 0 B."""
    out = F.format_string("%.1f B", size.cast("double"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", size / float(1024**k))).otherwise(out)
    return F.when(size == 0, "0 B").otherwise(out)


def human_duration(seconds: Column) -> Column:
    """The largest unit of days, hours, minutes and seconds, and the next one if it isn't zero."""
    s = F.floor(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    two = lambda a, x, b, y, sep=", ": F.when(b > 0, F.concat(a.cast("string"), F.lit(x + sep), b.cast("string"), F.lit(y))).otherwise(F.concat(a.cast("string"), F.lit(x)))
    return F.when(d > 0, two(d, "d", h, "h")).when(h > 0, two(h, "h", m, "m")).when(m > 0, F.concat(m.cast("string"), F.lit("m, "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat((s % 60).cast("string"), F.lit("s")))


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def clip_offset(seconds: Column) -> Column:
    return F.concat(F.lit("@ "), clock(seconds))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def folder_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def last_segments(folder: Column, depth: int) -> Column:
    """The last ``depth`` segments of a folder, last first, in lower case."""
    return F.slice(F.reverse(F.filter(F.split(F.lower(folder), "/"), lambda s: s != "")), 1, depth)


def is_media(path: Column, images: bool = True) -> Column:
    ext = F.concat(F.lit("."), F.element_at(F.split(F.lower(path), r"\."), -1))
    return ext.isin(*VIDEO_EXTENSIONS, *(IMAGE_EXTENSIONS if images else ()))


def prefix_with_slash(prefix: str) -> str:
    return prefix.rstrip("/") + "/"


def sample_time(duration: Column, position: Column | float, max_sampling: float = 0.0) -> Column:
    """Where in a file a position lies; only the first max_sampling seconds count, if given."""
    p = position if isinstance(position, Column) else F.lit(position)
    return (F.least(duration, F.lit(max_sampling)) if max_sampling > 0 else duration) * p


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * 100.0 / total).otherwise(0.0)


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Time left at the mean speed so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


def csv_field(value: Column) -> Column:
    """A field of a CSV line: quoted if it holds a comma, quote or line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n\\r]'), quoted).otherwise(text)
