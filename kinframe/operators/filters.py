"""Which catalog rows take part: validity reasons, include roots, exclusions, eligibility."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def included(folder: Column, roots: tuple[str, ...], recursive: bool = True) -> Column:
    """The folder is a root or below one; a first segment below it that starts with a dot is left out."""
    if not roots:
        return F.lit(False)
    if not recursive:
        return folder.isin(*(r.rstrip("/") for r in roots))
    out = []
    for r in (r.rstrip("/") for r in roots):
        below = folder.startswith(r + "/") & ~folder.startswith(r + "/.")
        out.append((folder == r) | below)
    return any_of(out)


def excluded(folder: Column, entries: tuple[str, ...]) -> Column:
    """A folder at or below an entry (any case); wildcards without a slash fit any segment, with one the whole path."""
    low, out = F.lower(folder), []
    for e in entries:
        entry = e.lower().rstrip("/")
        if "*" in entry or "?" in entry:
            if "/" in entry:
                out.append(low.like(K.glob_to_like(entry)))
            else:
                pattern = "^" + re.escape(entry).replace(r"\*", ".*").replace(r"\?", ".") + "$"
                out.append(F.exists(F.split(low, "/"), lambda s: s.rlike(pattern)))  # noqa: B023
        else:
            out.append((low == entry) | low.startswith(entry + "/"))
    return any_of(out)


def network_path(path: Column) -> Column:
    return path.rlike(r"^(/mnt/|/media/|/srv/|/nas/|\\\\|//)")


def invalid_reason(config: ScanConfig, enumeration: bool = False) -> Column:
    """The first reason for which a row (path, folder, file_size, flags, is_image, on_disk) is left out; null if none.

    ``enumeration`` is the check while files are listed: rows with errors are left out unless they are retried.
    """
    flag = lambda name: K.has_any(F.col("flags"), K.FLAGS[name])
    mb = K.size_mb(F.col("file_size"))
    rules: list[tuple[Column, str]] = []
    if not config.images:
        rules.append((F.col("is_image"), "images disabled"))
    rules.append((excluded(F.col("folder"), config.exclude), "excluded folder"))
    if not config.whole_catalog:
        rules.append((~included(F.col("folder"), config.include, config.recursive), "not included"))
    rules += [(flag("manually_excluded"), "manually excluded"), (flag("too_dark"), "too dark")]
    if enumeration and not config.retry_errors:
        rules += [(flag("metadata_error"), "metadata error"), (flag("thumbnail_error"), "thumbnail error")]
    rules += [(~F.col("on_disk"), "missing"), (~F.is_valid_utf8(F.col("path")), "bad path")]
    if config.min_size_mb is not None:
        rules.append((mb < config.min_size_mb, "too small"))
    if config.max_size_mb is not None:
        rules.append((mb > config.max_size_mb, "too large"))
    if config.must_match:
        rules.append((~any_of([K.glob(F.col("path"), g) for g in config.must_match]), "path must match"))
    if config.skip_reparse_points:
        rules.append((flag("reparse_point"), "reparse point"))
    if config.must_not_match:
        rules.append((any_of([K.glob(F.col("path"), g) for g in config.must_not_match]), "path must not match"))
    return F.coalesce(*(F.when(c, r) for c, r in rules))


def with_reason(catalog: DataFrame, config: ScanConfig, enumeration: bool = False) -> DataFrame:
    return catalog.withColumn("reason", invalid_reason(config, enumeration))


def reason_summary(catalog: DataFrame, keep: int = 5) -> DataFrame:
    """(reason, n, examples): rows a reason and its first few paths."""
    w = Window.partitionBy("reason").orderBy("path")
    first = catalog.where("reason is not null").withColumn("rn", F.row_number().over(w))
    return first.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", F.array_sort(F.collect_list(F.when(F.col("rn") <= keep, F.col("path"))))).alias("examples"))


def comparable(positions: int = 1) -> Column:
    """A row that may be compared: no reason against it, media data, no thumbnail error, enough frames of a video."""
    frames = F.col("is_image") | (F.col("n_frames") >= positions)
    return F.col("reason").isNull() & F.col("has_media_info") & ~K.has_any(F.col("flags"), K.FLAGS["thumbnail_error"]) & frames


def gather_skip(config: ScanConfig) -> Column:
    """Rows whose features aren't gathered again."""
    return K.has_any(F.col("flags"), K.FLAGS["thumbnail_error"]) & F.lit(not config.retry_errors)


def complete(frames: Column) -> Column:
    """Every position's frame is there."""
    return F.forall(frames, lambda x: x.isNotNull())


def silent(fingerprint: Column) -> Column:
    """Not empty, and zeros only."""
    return (F.size(fingerprint) > 0) & F.forall(fingerprint, lambda x: x == 0)


def best_stream(streams: Column, kind: str) -> Column:
    """The video stream with most pixels or the audio stream with most channels; ties go to the first."""
    rank = (lambda s: s["width"] * s["height"]) if kind == "video" else (lambda s: s["channels"])
    own = F.filter(F.transform(streams, lambda s, i: F.struct(F.coalesce(rank(s), F.lit(0)).alias("r"), (-i).alias("i"), s.alias("s"))), lambda x: x["s"]["codec_type"] == kind)
    return F.array_max(F.transform(own, lambda x: F.struct(x["r"].alias("r"), x["i"].alias("i"), x["s"].alias("s"))))["s"]


def search_groups(items: DataFrame, term: str) -> DataFrame:
    """Groups of which any member's path holds the term, in any case."""
    hits = items.where(F.lower("path").contains(term.lower())).select("group_id").distinct()
    return items.join(hits, "group_id", "left_semi")


def custom_selection(items: DataFrame, kind: str = "all", min_mb: int | None = None, max_mb: int | None = None, contains_all: tuple[str, ...] = (), contains_none: tuple[str, ...] = (), min_similarity: float = 0, max_similarity: float = 100) -> DataFrame:
    """Rows that fit all conditions of a user's selection."""
    c = F.col("similarity").between(min_similarity, max_similarity)
    if kind != "all":
        c = c & (F.col("is_image") == (kind == "image"))
    if min_mb is not None:
        c = c & (K.size_mb(F.col("size")) >= min_mb)
    if max_mb is not None:
        c = c & (K.size_mb(F.col("size")) <= max_mb)
    for g in contains_all:
        c = c & K.glob(F.col("path"), g)
    for g in contains_none:
        c = c & ~K.glob(F.col("path"), g)
    return items.where(c)


#: What a user's expression may name.
EXPRESSION_COLUMNS = frozenset("path size duration_s frame_size fps bitrate_kbps audio_kbps audio_rate hdr_rank similarity is_image date_created group_id".split())
EXPRESSION_FUNCTIONS = frozenset("abs lower upper length like rlike ilike contains startswith endswith coalesce greatest least floor ceil round year month day if case when then else end and or not in between is null true false".split())


def expression_filter(items: DataFrame, text: str) -> DataFrame:
    """Rows that a user's boolean expression selects, and whether their whole group is (all_match).

    Only the item's columns and a list of functions may be named; anything else raises ValueError.
    """
    plain = re.sub(r"'(?:[^'\\]|\\.)*'", " ", text)
    if ";" in plain or "--" in plain or "/*" in plain:
        raise ValueError("expression must be a single condition")
    unknown = {w for w in re.findall(r"[A-Za-z_]\w*", plain) if w.lower() not in EXPRESSION_FUNCTIONS | EXPRESSION_COLUMNS}
    if unknown:
        raise ValueError(f"unknown names: {sorted(unknown)}")
    hit = F.coalesce(F.expr(text).cast("boolean"), F.lit(False))
    w = Window.partitionBy("group_id")
    marked = items.withColumn("_hit", hit).withColumn("all_match", F.count_if("_hit").over(w) == F.count(F.lit(1)).over(w))
    return marked.where("_hit").drop("_hit")
