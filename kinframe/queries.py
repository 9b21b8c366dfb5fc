"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import audio
from kinframe.functions import kernels as K
from kinframe.functions.phash import phash
from kinframe.operators import blocks
from kinframe.operators import catalog as C
from kinframe.operators import clips as CL
from kinframe.operators import diagnostics, filters, grouping, pairs, ranking, results
from kinframe.operators import selection as SEL
from kinframe.plans.engine import MediaEngine
from kinframe.sources import driver_tables as D
from kinframe.sources import adapters, bundle, files, probe
from kinframe.streaming import catalog_stream as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ITEMS, RANKED, CATALOG = (f"WITH {x.strip()}" for x in (D.ITEMS_SQL, D.RANKED_SQL, D.CATALOG_SQL))
CONFIG = ScanConfig(whole_catalog=True, percent=96.0, duration_percent=20.0, size_percent=50.0, resolution_gate=True, skip_hard_links=True)
#: Rules for the catalog of ``part``.
RULES = ScanConfig(include=("/media/lib1", "/media/lib2", "/media/lib3", "/media/lib4"), exclude=("/media/lib3", "*_13"), min_size_mb=50, max_size_mb=2500, must_match=("*item*",), must_not_match=("*7.mkv",), skip_reparse_points=True)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ids(found: DataFrame, *more) -> DataFrame:
    return found.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *more)


# --- hashes and frames -------------------------------------------------------------------------------------


@query(f"{ITEMS} SELECT id, lo, hi FROM items")
def phash_from_embedding(spark, d):
    """Median-split hashes as column expressions; the clones' come from the catalog."""
    v = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).withColumn("med", K.median_of_64(F.col("v")))
    own = v.select("id", K.half_hash(F.col("v"), F.col("med"), 0).alias("lo"), K.half_hash(F.col("v"), F.col("med"), 1).alias("hi"))
    return own.unionByName(D.items(spark, d).where("id <> src").select("id", "lo", "hi"))


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INTEGER) AS distance FROM items a JOIN items b ON a.id < b.id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 16")
def hamming_pairs(spark, d):
    """All pairs within 16 bits, by balls round segments whose length follows from the table's size."""
    return ids(pairs.pigeonhole_pairs(D.items(spark, d), 16, []), "distance")


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INTEGER) AS distance FROM items a JOIN items b ON a.id < b.id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 2")
def pigeonhole_pairs(spark, d):
    return ids(pairs.pigeonhole_pairs(D.items(spark, d), 2, []), "distance")


def _key_sql(bits, side):
    return " + ".join(f"((({side}.{'lo' if b < 32 else 'hi'} >> {b % 32}) & 1) << {k})" for k, b in enumerate(bits))


_TABLES = pairs.lsh_tables()


@query(
    f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INTEGER) AS distance FROM items a JOIN items b ON a.id < b.id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 12 AND ("
    + " OR ".join(f"bit_count(xor({_key_sql(t, 'a')}, {_key_sql(t, 'b')})) <= 1" for t in _TABLES)
    + ")"
)
def lsh_candidates_seeded(spark, d):
    return ids(pairs.lsh_pairs(D.items(spark, d), 12, []), "distance")


_SAD = "list_sum(list_transform(range(1, 65), lambda i: abs(a.frame[i] - b.frame[i]))) / 64.0 / 256.0"


@query(f"{ITEMS}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_SAD} AS difference FROM items a JOIN items b ON a.id < b.id) SELECT a_id, b_id, round(difference, 6) AS difference FROM p WHERE difference <= 0.04")
def gray_sad_pairs(spark, d):
    found = blocks.frame_matches(D.items(spark, d), ScanConfig(), by_duration=False, by_kind=False, limit=0.04)
    return found.select("a_id", "b_id", F.round("difference", 6).alias("difference"))


_KEPT = "list_filter(range(1, 65), lambda i: a.frame[i] > 32 AND b.frame[i] > 32 AND a.frame[i] < 240 AND b.frame[i] < 240)"


@query(
    f"""{ITEMS}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_KEPT} AS k, a.frame AS x, b.frame AS y FROM items a JOIN items b ON a.id < b.id AND a.is_image = b.is_image AND (a.is_image OR abs(a.duration_s - b.duration_s) <= least(a.duration_s * 0.2, b.duration_s * 0.2))),
q AS (SELECT a_id, b_id, CAST(list_sum(list_transform(k, lambda i: abs(x[i] - y[i]))) AS FLOAT) / CAST(len(k) AS FLOAT) / CAST(256 AS FLOAT) AS difference FROM p WHERE len(k) > 0)
SELECT a_id, b_id, round(CAST(difference AS DOUBLE), 5) AS difference FROM q WHERE difference <= CAST(0.04 AS FLOAT)"""
)
def gray_masked_pairs(spark, d):
    """Pairs within the tolerance of durations that match where neither frame is black or white."""
    c = ScanConfig(whole_catalog=True, percent=96.0, ignore_black=True, ignore_white=True)
    found = pairs.all_matches(D.items(spark, d), c)
    return ids(found, F.round("difference", 5).alias("difference"))


_MIRROR = "list_sum(list_transform(range(0, 64), lambda i: abs(a.frame[(i // 8) * 8 + 8 - i % 8] - b.frame[i + 1]))) / 64.0 / 256.0"


@query(f"{ITEMS}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_SAD} AS plain, {_MIRROR} AS mirrored FROM items a JOIN items b ON a.id < b.id) SELECT a_id, b_id, round(least(plain, mirrored), 6) AS difference, mirrored < plain AS flipped FROM p WHERE least(plain, mirrored) <= 0.2")
def flipped_pairs(spark, d):
    found = blocks.frame_matches(D.items(spark, d), ScanConfig(flipped=True), by_duration=False, by_kind=False, limit=0.2)
    half_up = F.floor(F.col("difference") * 1e6 + 0.5) / 1e6  # a difference is a whole number of 2 ** -14: exact, and without a decimal a row
    return found.select("a_id", "b_id", half_up.alias("difference"), "flipped")


@query(f"{ITEMS} SELECT id, CAST(len(list_filter(frame, lambda x: x <= 32)) AS INTEGER) AS n_dark, len(list_filter(frame, lambda x: x <= 32)) * 100.0 / 64 >= 80 AS too_dark, list_reverse(frame[1:8])[1] AS first_flipped FROM items")
def too_dark(spark, d):
    return D.items(spark, d).select("id", F.size(F.filter("frame", lambda x: x <= K.DARK)).alias("n_dark"), K.is_dark(F.col("frame")).alias("too_dark"), F.get(K.flipped(F.col("frame"), D.SIDE), F.lit(0)).alias("first_flipped"))


@query()
def phash_kernel(spark, d):
    """Hashes of 32 x 32 frames: every item's mini-frame, each pixel four by four."""
    row = lambda k: F.flatten(F.transform(F.slice("frame", 8 * k + 1, 8), lambda p: F.array_repeat(p, 4)))
    pixels = F.flatten(F.array(*(row(k) for k in range(8) for _ in range(4))))
    hexes = F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    return D.items(spark, d).select("id", phash(hexes).alias("phash"))


# --- blocking and gates ------------------------------------------------------------------------------------

_TOL = "abs(a.duration_s - b.duration_s) <= least(a.duration_s * 0.05, b.duration_s * 0.05)"


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id FROM items a JOIN items b ON a.id < b.id AND NOT a.is_image AND NOT b.is_image WHERE {_TOL}")
def duration_band_pairs(spark, d):
    return ids(pairs.duration_pairs(D.items(spark, d).where("NOT is_image"), ScanConfig(duration_percent=5.0), []))


_SAME = "items a JOIN items b ON a.label = b.label AND a.id < b.id"


def _same_label(spark, d, *keep):
    return pairs.keyed_pairs(D.items(spark, d), ["label"], [*keep])


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id FROM {_SAME} WHERE b.size BETWEEN trunc(a.size * (1.0 - 0.1)) AND trunc(a.size * (1.0 + 0.1))")
def size_gate(spark, d):
    return ids(_same_label(spark, d, "size").where(pairs.size_gate(F.col("a.size"), F.col("b.size"), 10.0)))


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id FROM {_SAME} WHERE least(a.width, b.width) >= greatest(a.width, b.width) // 2 AND least(a.height, b.height) >= greatest(a.height, b.height) // 2")
def resolution_gate(spark, d):
    return ids(_same_label(spark, d, "width", "height").where(pairs.resolution_gate(F.col("a.width"), F.col("a.height"), F.col("b.width"), F.col("b.height"))))


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id FROM {_SAME} WHERE list_reverse(string_split(lower(a.folder), '/'))[1] = list_reverse(string_split(lower(b.folder), '/'))[1]")
def folder_gate(spark, d):
    """Folders' last segments are a key like the label, so that only pairs that pass are made."""
    x = D.items(spark, d).withColumn("last", K.last_segments(F.col("folder"), 1))
    return ids(pairs.keyed_pairs(x, ["label", "last"], []))


_DIST = "bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi))"
_GATES = f"""a.is_image = b.is_image AND {_DIST} <= 32 AND (a.is_image OR abs(a.duration_s - b.duration_s) <= least(a.duration_s * 0.2, b.duration_s * 0.2))
AND b.size BETWEEN trunc(a.size * 0.5) AND trunc(a.size * 1.5) AND least(a.width, b.width) >= greatest(a.width, b.width) // 2 AND least(a.height, b.height) >= greatest(a.height, b.height) // 2 AND a.file_id <> b.file_id"""


@query(f"{ITEMS} SELECT a.id AS a_id, b.id AS b_id, {_SAD} AS difference FROM items a JOIN items b ON a.id < b.id WHERE {_GATES} AND {_SAD} <= 0.04")
def all_gates(spark, d):
    x = D.items(spark, d)
    return ids(pairs.all_matches(x, CONFIG), "difference")


@query(
    f"""{ITEMS}, p AS (SELECT a.id AS a_id, b.id AS b_id, CAST({_DIST} AS INTEGER) AS distance, {_SAD} AS difference, a.is_image = b.is_image AS gate_kind, {_DIST} <= 32 AS gate_quick, a.is_image OR abs(a.duration_s - b.duration_s) <= least(a.duration_s * 0.2, b.duration_s * 0.2) AS gate_duration,
  b.size BETWEEN trunc(a.size * 0.5) AND trunc(a.size * 1.5) AS gate_size, least(a.width, b.width) >= greatest(a.width, b.width) // 2 AND least(a.height, b.height) >= greatest(a.height, b.height) // 2 AS gate_resolution, true AS gate_folder, a.file_id <> b.file_id AS gate_hard_link FROM items a JOIN items b ON a.id < b.id AND (a.src = b.src OR a.src + 1 = b.src)),
m AS (SELECT *, CAST(difference AS FLOAT) <= CAST(1 AS FLOAT) - CAST(96 AS FLOAT) / CAST(100 AS FLOAT) AS metric_ok FROM p)
SELECT * REPLACE (round(difference, 6) AS difference), CASE WHEN gate_kind AND gate_quick AND gate_duration AND gate_size AND gate_resolution AND gate_hard_link AND metric_ok THEN 'match' ELSE 'no match: ' || concat_ws(', ', CASE WHEN NOT gate_kind THEN 'kind' END, CASE WHEN NOT gate_quick THEN 'quick' END, CASE WHEN NOT gate_duration THEN 'duration' END,
  CASE WHEN NOT gate_size THEN 'size' END, CASE WHEN NOT gate_resolution THEN 'resolution' END, CASE WHEN NOT gate_hard_link THEN 'hard_link' END, CASE WHEN NOT metric_ok THEN 'metric' END) END AS verdict FROM m"""
)
def explain_pair(spark, d):
    """Every item with its clone and with the items after it."""
    x = D.items(spark, d)
    s = F.struct(*x.columns)
    near = x.select(F.explode(F.array("src", F.col("src") + 1)).alias("k"), s.alias("a")).join(x.select(F.col("src").alias("k"), s.alias("b")), "k")
    return diagnostics.explain_pairs(near.where("a.id < b.id").select("a", "b"), CONFIG)


POSITIONS = f"""{ITEMS}, pos AS (SELECT id // 4 AS g, list(lo ORDER BY id) AS lo, list(hi ORDER BY id) AS hi, list(frame ORDER BY id) AS f FROM base GROUP BY id // 4 HAVING count(*) = 4),
entries AS (SELECT CAST(g AS BIGINT) AS id, lo, hi, f FROM pos UNION ALL SELECT CAST(g + {D.CLONE} AS BIGINT), list_transform(lo, lambda x, j: xor(x, CAST(1 AS BIGINT) << CAST(j * 5 AS INTEGER))), hi,
  list_transform(f, lambda v, j: list_transform(v, lambda x, i: greatest(0, least(255, x + (i + j) % 5 - 2)))) FROM pos WHERE g % 3 = 0)"""


@query(
    f"""{POSITIONS}, p AS (SELECT a.id AS a_id, b.id AS b_id, list_transform(range(1, 5), lambda i: bit_count(xor(a.lo[i], b.lo[i])) + bit_count(xor(a.hi[i], b.hi[i]))) AS d FROM entries a JOIN entries b ON a.id < b.id)
SELECT a_id, b_id, round(1 - list_sum(d) / 4.0 / 64.0, 6) AS similarity FROM p WHERE len(list_filter(d, lambda x: x > 6)) = 0"""
)
def multi_position_match(spark, d):
    """Entries of four positions each: every position's hash must be within the bits, the mean counts."""
    c = ScanConfig(whole_catalog=True, positions=4, percent=90.0, use_phash=True)
    found = pairs.all_matches(D.position_items(spark, d), c)
    return ids(found, F.round(1 - F.col("difference"), 6).alias("similarity"))


_FOUR = "list_sum(list_transform(range(1, 5), lambda j: list_sum(list_transform(range(1, 65), lambda i: abs(a.f[j][i] - b.f[j][i]))) / 64.0 / 256.0)) / 4"


@query(f"{POSITIONS}, p AS (SELECT a.id AS a_id, b.id AS b_id, {_FOUR} AS difference FROM entries a JOIN entries b ON a.id < b.id AND len(list_filter(range(1, 5), lambda j: bit_count(xor(a.lo[j], b.lo[j])) + bit_count(xor(a.hi[j], b.hi[j])) > 32)) = 0) SELECT a_id, b_id, round(difference, 6) AS difference FROM p WHERE difference <= 0.04")
def multi_position_gray(spark, d):
    """The same by the mean difference of the four positions' frames."""
    found = pairs.all_matches(D.position_items(spark, d), ScanConfig(whole_catalog=True, positions=4, percent=96.0))
    return ids(found, F.round("difference", 6).alias("difference"))


# --- graph -------------------------------------------------------------------------------------------------

_NEAR = f"near AS (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id < b.id WHERE {_DIST} <= 18)"


@query(
    f"{ITEMS.replace('WITH', 'WITH RECURSIVE', 1)}, {_NEAR}, both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT both_ways.b AS id, reach.r FROM reach JOIN both_ways ON reach.id = both_ways.a) SELECT id, min(r) AS component FROM reach GROUP BY id"
)
def components(spark, d):
    near = ids(pairs.pigeonhole_pairs(D.items(spark, d), 18, []))
    return grouping.connected_components(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query()
def duplicate_groups(spark, d):
    return flagship(spark, d)


@query()
def daisy_split(spark, d):
    """Groups at a loose threshold, where chains are split."""
    c = ScanConfig(whole_catalog=True, percent=75.0, use_phash=True, duration_percent=100.0, duration_max_s=1e6)
    x = D.items(spark, d)
    found = ids(pairs.pigeonhole_pairs(x, c.max_bits, []), "distance")
    found = found.select("a_id", "b_id", (F.col("distance") / 64.0).alias("difference"), F.lit(False).alias("flipped"))
    return grouping.duplicate_groups(x.drop("is_image"), found, c)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups of the media catalog, annotated."""
    return MediaEngine(spark, CONFIG).run(D.items(spark, d)).select("id", "group_id", F.round("similarity", 4).alias("similarity"), "flipped", "path", "is_best_size")


# --- clips -------------------------------------------------------------------------------------------------


def videos(spark, d):
    """Sources with fingerprints of 24 values, and clips cut out of some of them with flipped bits."""
    x = D.base_items(spark, d).select("id", "lo", "hi", F.floor(F.col("id") / 12).alias("g"), (F.col("id") % 12).alias("k"))
    s = x.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("v")).where(F.size("v") == 12)
    s = s.select("g", F.flatten(F.transform("v", lambda v: F.array(v["lo"], v["hi"]))).alias("fp"))
    source = s.select((2 * F.col("g")).cast("long").alias("id"), (200.0 + F.col("g") * 3).alias("duration_s"), "fp")
    clip = s.where("g % 3 = 0").select((2 * F.col("g") + 1).cast("long").alias("id"), (60.0 + F.col("g")).alias("duration_s"), F.transform(F.slice("fp", (F.col("g") % 8 + 3).cast("int"), 8), lambda x: x.bitwiseXOR(F.lit(5).cast("long"))).alias("fp"))
    return source.unionByName(clip)


VIDEOS = f"""{ITEMS}, g AS (SELECT id // 12 AS g, list([lo, hi] ORDER BY id) AS v FROM base GROUP BY id // 12 HAVING count(*) = 12), s AS (SELECT g, flatten(v) AS fp FROM g),
videos AS (SELECT CAST(2 * g AS BIGINT) AS id, 200.0 + g * 3 AS duration_s, fp FROM s UNION ALL SELECT CAST(2 * g + 1 AS BIGINT), 60.0 + g, list_transform(fp[g % 8 + 3 : g % 8 + 10], lambda x: xor(x, 5)) FROM s WHERE g % 3 = 0),
ordered AS (SELECT *, row_number() OVER (ORDER BY duration_s DESC, id) - 1 AS idx FROM videos),
p AS (SELECT a.id AS source_id, a.idx AS source_idx, b.id AS clip_id, a.fp AS x, b.fp AS y, unnest(range(0, len(a.fp) - len(b.fp) + 1)) AS o FROM ordered a JOIN ordered b ON a.id <> b.id AND b.duration_s / a.duration_s >= 0.1 AND b.duration_s / a.duration_s < 0.95 AND len(b.fp) < len(a.fp)),
q AS (SELECT source_id, source_idx, clip_id, o, len(y) * 32 AS n, list_sum(list_transform(range(1, len(y) + 1), lambda i: bit_count(xor(y[i], x[i + o])))) AS bits FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, clip_id ORDER BY bits, o) AS k FROM q WHERE bits <= floor(CAST(CAST(1 AS FLOAT) - CAST(0.8 AS FLOAT) AS FLOAT) * n)),
m AS (SELECT source_id, source_idx, clip_id, 1.0 - bits / n AS similarity, o FROM r WHERE k = 1)"""


@query(f"{VIDEOS} SELECT source_id, clip_id, round(similarity, 6) AS similarity, CAST(o AS INTEGER) AS offset_s FROM m")
def sliding_match(spark, d):
    return CL.clip_matches(CL.by_duration(videos(spark, d))).select("source_id", "clip_id", F.round("similarity", 6).alias("similarity"), "offset_s")


@query(f"{VIDEOS} SELECT source_id AS group_id, clip_id, CAST(o AS INTEGER) AS offset_s FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY source_idx) AS rn FROM m) WHERE rn = 1")
def clip_assignments(spark, d):
    return CL.assign_clips(CL.clip_matches(CL.by_duration(videos(spark, d)))).select("group_id", "clip_id", "offset_s")


@query(f"{VIDEOS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY source_idx) AS rn FROM m) WHERE rn = 1) SELECT DISTINCT source_id AS group_id, source_id AS id, false AS is_clip, 0 AS offset_s FROM a UNION ALL SELECT source_id, clip_id, true, CAST(o AS INTEGER) FROM a")
def clip_items(spark, d):
    return CL.clip_items(CL.assign_clips(CL.clip_matches(CL.by_duration(videos(spark, d))))).drop("similarity")


@query("SELECT user_id % 50 AS k, len(list(value)) > 0 AND list_sum(list_transform(list(CAST(floor(value) AS BIGINT) // 1000000), lambda x: abs(x))) = 0 AS silent FROM events GROUP BY 1")
def silent_fp(spark, d):
    e = D.table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("k")).agg(F.collect_list(F.expr("cast(floor(value) as bigint) div 1000000")).alias("fp"))
    return e.select("k", filters.silent(F.col("fp")).alias("silent"))


_VOTE = " + ".join(f"CASE WHEN sum((v >> {b}) & 1) >= count(*) // 2 + 1 THEN CAST({1 << b} AS BIGINT) ELSE 0 END" for b in range(32))


@query(f"SELECT k, CAST({_VOTE} AS BIGINT) AS fp FROM (SELECT user_id % 97 AS k, (event_id * 2654435761) % 4294967296 AS v FROM events) GROUP BY k")
def majority_vote(spark, d):
    e = D.table(spark, d, "events").select((F.col("user_id") % 97).alias("k"), (F.col("event_id") * 2654435761 % 4294967296).alias("fp"))
    return CL.majority_vote(e, ["k"])


@query()
def audio_fingerprint(spark, d):
    """Fingerprints of synthetic tones, one a nation."""
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))

    @F.pandas_udf("array<long>")
    def tones(ids):
        t = np.arange(3 * audio.RATE) / audio.RATE
        return ids.map(lambda i: audio.fingerprint((8000 * np.sin(2 * np.pi * 110 * 2 ** (i / 12) * t)).astype(np.int16)))

    return n.select("id", tones("id").alias("fp"))


@query("SELECT conv_id, turn, CASE WHEN a IS NULL THEN NULL ELSE round((a * 0.25 + b * 0.5 + c + e * 0.5 + x * 0.25) / 2.5, 6) END AS smooth FROM (SELECT conv_id, turn, length(text) AS x, lag(length(text), 4) OVER w AS a, lag(length(text), 3) OVER w AS b, lag(length(text), 2) OVER w AS c, lag(length(text), 1) OVER w AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def fir_smoothing(spark, d):
    c = D.table(spark, d, "conversations").select("conv_id", "turn", F.array(F.length("text").cast("double")).alias("chroma"))
    return ranking.smooth(c, ["conv_id"], "turn").select("conv_id", "turn", F.round(F.get("smooth", F.lit(0)), 6).alias("smooth"))


# --- validity ----------------------------------------------------------------------------------------------

_REASON = """CASE WHEN lower(folder) = '/media/lib3' OR starts_with(lower(folder), '/media/lib3/') OR len(list_filter(string_split(lower(folder), '/'), lambda s: ends_with(s, '_13'))) > 0 THEN 'excluded folder'
WHEN NOT (starts_with(folder, '/media/lib1/') OR starts_with(folder, '/media/lib2/') OR starts_with(folder, '/media/lib3/') OR starts_with(folder, '/media/lib4/')) THEN 'not included'
WHEN flags & 2 <> 0 THEN 'manually excluded' WHEN flags & 16 <> 0 THEN 'too dark' WHEN NOT on_disk THEN 'missing'
WHEN trunc(CAST(file_size AS FLOAT) / CAST(1048576 AS FLOAT)) < 50 THEN 'too small' WHEN trunc(CAST(file_size AS FLOAT) / CAST(1048576 AS FLOAT)) > 2500 THEN 'too large'
WHEN NOT path ILIKE '%item%' THEN 'path must match' WHEN flags & 256 <> 0 THEN 'reparse point' WHEN path ILIKE '%7.mkv' THEN 'path must not match' END"""


@query(f"{CATALOG} SELECT id, {_REASON} AS reason FROM catalog")
def validity_reasons(spark, d):
    return filters.with_reason(D.catalog(spark, d), RULES).select("id", "reason")


@query(f"{CATALOG}, r AS (SELECT path, {_REASON} AS reason FROM catalog), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS rn FROM r WHERE reason IS NOT NULL) SELECT reason, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN path END, '|' ORDER BY path) AS examples FROM n GROUP BY reason")
def reason_summary(spark, d):
    return filters.reason_summary(filters.with_reason(D.catalog(spark, d), RULES))


@query("SELECT page_id FROM pages WHERE url ILIKE '%/en/%' AND url ILIKE 'https://%example.___/%'")
def glob_filter(spark, d):
    p = D.table(spark, d, "pages")
    return p.where(K.glob(F.col("url"), "*/en/*") & K.glob(F.col("url"), "https://*example.???/*")).select("page_id")


@query(f"{CATALOG} SELECT id, (folder = '/media/lib1' OR starts_with(folder, '/media/lib1/') OR folder = '/media/lib2/Brand_21') AS included, folder IN ('/media/lib1') AS flat FROM catalog")
def include_roots(spark, d):
    f = F.col("folder")
    return D.catalog(spark, d).select("id", filters.included(f, ("/media/lib1", "/media/lib2/Brand_21/")).alias("included"), filters.included(f, ("/media/lib1",), False).alias("flat"))


@query(f"{CATALOG} SELECT id, lower(path[-4:]) IN ('.mp4', '.jpg', '.mkv', '.png') AS media, CAST(len(path) - len(replace(path, '/', '')) AS INTEGER) AS depth, CAST(trunc(CAST(file_size AS FLOAT) / CAST(1048576 AS FLOAT)) AS BIGINT) AS mb, flags & 28 <> 0 AS error, flags | 2 AS marked FROM catalog")
def path_functions(spark, d):
    c = F.col("flags")
    return D.catalog(spark, d).select("id", K.is_media(F.col("path")).alias("media"), K.folder_depth(F.col("path")).alias("depth"), K.size_mb(F.col("file_size")).alias("mb"), K.has_any(c, K.ALL_ERRORS).alias("error"), K.with_flag(c, 2).alias("marked"))


@query(f"{CATALOG} SELECT id FROM catalog WHERE {_REASON.replace('CASE', '(CASE', 1)}) IS NULL AND flags & 4 = 0 AND (is_image OR version >= 2)")
def compare_eligible(spark, d):
    c = filters.with_reason(D.catalog(spark, d), RULES).withColumns({"has_media_info": F.lit(True), "n_frames": F.col("version")})
    return c.where(filters.comparable(2)).select("id")


@query("SELECT event_id, CASE WHEN h = 0 THEN m || 'm, ' || s || 's' WHEN m > 0 THEN h || 'h, ' || m || 'm' ELSE h || 'h' END AS human, printf('@ %02d:%02d:%02d', h, m, s) AS clip FROM (SELECT event_id, event_id % 20000 + 60 AS t, (event_id % 20000 + 60) // 3600 AS h, (event_id % 20000 + 60) // 60 % 60 AS m, (event_id % 20000 + 60) % 60 AS s FROM events)")
def durations_to_string(spark, d):
    t = F.col("event_id") % 20000 + 60
    return D.table(spark, d, "events").select("event_id", K.human_duration(t).alias("human"), K.clip_offset(t).alias("clip"))


@query("SELECT o_orderkey, CASE WHEN s >= 1073741824 THEN printf('%.1f GB', s / 1073741824.0) WHEN s >= 1048576 THEN printf('%.1f MB', s / 1048576.0) WHEN s >= 1024 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f B', CAST(s AS DOUBLE)) END AS human FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 3 + 1 AS BIGINT) AS s FROM orders)")
def bytes_to_string(spark, d):
    return D.table(spark, d, "orders").select("o_orderkey", K.human_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 3 + 1).alias("human"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'HLG' WHEN 1 THEN 'Dolby Vision' WHEN 2 THEN 'HDR10+' WHEN 3 THEN 'HDR10' ELSE '' END AS hdr, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS rank FROM part")
def hdr_format(spark, d):
    k = F.col("p_partkey") % 5
    transfer = F.when(k == 0, "ARIB-STD-B67").when(k == 4, "bt709").otherwise("smpte2084")
    side = F.when(k == 1, "DOVI configuration record").when(k == 2, "HDR Dynamic Metadata SMPTE2094-40 (HDR10+)")
    p = D.table(spark, d, "part").select("p_partkey", K.hdr_format(transfer, side).alias("hdr"))
    return p.withColumn("rank", K.hdr_rank(F.col("hdr")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE floor(p_partkey * 1.5) END AS duration_s, CAST(1 + p_partkey % 2 AS INTEGER) AS n_streams, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 100 ELSE p_partkey * 10 END AS BIGINT) AS bit_rate, 25.0 AS fps FROM part")
def probe_json(spark, d):
    k = F.col("p_partkey")
    stream = F.concat(F.lit('{"index":0,"codec_type":"video","width":640,"height":480,"r_frame_rate":"50/2"'), F.when(k % 4 != 0, F.concat(F.lit(',"bit_rate":"'), (k * 10).cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))
    more = F.when(k % 2 == 1, ',{"index":1,"codec_type":"audio","channels":2}').otherwise("")
    duration = F.when(k % 3 == 0, "0").otherwise((k * 1.5).cast("string"))
    text = F.concat(F.lit('{"streams":['), stream, more, F.lit('],"format":{"duration":"'), duration, F.lit('","bit_rate":"'), (k * 100).cast("string"), F.lit('"}}'))
    p = D.table(spark, d, "part").select("p_partkey", probe.media_info(text).alias("m"))
    return p.select("p_partkey", "m.duration_s", F.size("m.streams").alias("n_streams"), F.col("m.streams")[0]["bit_rate"].alias("bit_rate"), F.col("m.streams")[0]["frame_rate"].cast("double").alias("fps"))


# --- results -----------------------------------------------------------------------------------------------


@query(f"{RANKED}, s AS (SELECT count(*) AS n FROM ranked GROUP BY group_id) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_items, round(avg(n), 6) AS avg_size, max(n) AS max_size, count(*) FILTER (n > 5) AS over_5, count(*) FILTER (n > 10) AS over_10 FROM s")
def group_stats(spark, d):
    return results.group_stats(D.ranked_items(spark, d))


@query(f"{RANKED}, g AS (SELECT count(*) AS n, sum(size) AS t, max(size) AS m FROM ranked GROUP BY group_id HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(t) AS BIGINT) AS total_bytes, CAST(sum(t - m) AS BIGINT) AS savings FROM g")
def results_totals(spark, d):
    return results.totals(D.ranked_items(spark, d))


_FIRST = "first_value(is_image) OVER (PARTITION BY group_id ORDER BY path)"


@query(
    f"""{RANKED}, f AS (SELECT *, {_FIRST} AS im FROM ranked) SELECT group_id, path, NOT im AND duration_s = max(duration_s) OVER w AS is_best_duration, NOT im AND fps = max(fps) OVER w AS is_best_fps, NOT im AND bitrate_kbps = max(bitrate_kbps) OVER w AS is_best_bitrate,
NOT im AND audio_rate = max(audio_rate) OVER w AS is_best_audio_rate, NOT im AND audio_kbps = max(audio_kbps) OVER w AS is_best_audio_bitrate, NOT im AND hdr_rank = max(hdr_rank) OVER w AS is_best_hdr, size = min(size) OVER w AS is_best_size, frame_size = max(frame_size) OVER w AS is_best_frame_size FROM f WINDOW w AS (PARTITION BY group_id)"""
)
def best_flags(spark, d):
    x = ranking.best_flags(D.ranked_items(spark, d))
    return x.select("group_id", "path", *(c for c in x.columns if c.startswith("is_best")))


_ORDER = "CASE WHEN im THEN NULL ELSE duration_s END DESC NULLS LAST, frame_size DESC, CASE WHEN im THEN NULL ELSE fps END DESC NULLS LAST, CASE WHEN im THEN NULL ELSE bitrate_kbps END DESC NULLS LAST, audio_kbps DESC, CASE WHEN im THEN NULL ELSE hdr_rank END DESC NULLS LAST, size, audio_rate DESC, path"


@query(f"{RANKED}, f AS (SELECT *, {_FIRST} AS im FROM ranked), r AS (SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY {_ORDER}) AS rn FROM f) SELECT group_id, path, rn = 1 AS keeper FROM r")
def keeper(spark, d):
    return ranking.keepers(D.ranked_items(spark, d)).select("group_id", "path", "keeper")


@query(f"{RANKED}, f AS (SELECT *, {_FIRST} AS im FROM ranked), r AS (SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY size, audio_kbps DESC, {_ORDER}) AS rn FROM f) SELECT group_id, path FROM r WHERE rn > 1")
def all_but_keeper_custom(spark, d):
    return ranking.select_all_but_keeper(D.ranked_items(spark, d), ["Size", "Audio Bitrate"]).select("group_id", "path")


def _strategy(name: str, order: str, more: str = "", cte: str = "") -> None:
    def run(spark, d):
        return ranking.strategy_deletions(D.ranked_items(spark, d), name).select("group_id", "path")

    run.__name__ = f"strategy_{name}"
    query(f"{RANKED}{cte}, r AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, min(similarity) OVER (PARTITION BY group_id) AS low, row_number() OVER (PARTITION BY group_id ORDER BY {order}path) AS rn FROM {'f' if cte else 'ranked'}) SELECT group_id, path FROM r WHERE n >= 2 AND rn > 1{more}")(run)


_strategy("smallest_file", "size DESC, ")
_strategy("shortest_duration", "duration_s DESC, ")
_strategy("worst_resolution", "frame_size DESC, ")
_strategy("hundred_percent_only", "", " AND low >= 100")
_strategy("lowest_quality", "bb DESC, bf DESC, bitrate_kbps DESC, frame_size DESC, size DESC, ", "", f", f0 AS (SELECT *, {_FIRST} AS im FROM ranked), f AS (SELECT *, NOT im AND bitrate_kbps = max(bitrate_kbps) OVER (PARTITION BY group_id) AS bb, frame_size = max(frame_size) OVER (PARTITION BY group_id) AS bf FROM f0)")


def _autoselect(name: str, order: str, where: str = "") -> None:
    def run(spark, d):
        return ranking.autoselect(D.ranked_items(spark, d), name).select("group_id", "path")

    run.__name__ = f"autoselect_{name}"
    query(f"{RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}path) AS rn FROM ranked{where}) SELECT group_id, path FROM r WHERE rn = 1")(run)


_autoselect("lowest_quality", "frame_size, bitrate_kbps, ")
_autoselect("smallest_file", "size, ")
_autoselect("oldest", "date_created, ")
_autoselect("newest", "date_created DESC, ")
_autoselect("hundred_percent_equal", "", " WHERE abs(similarity - 100) < 0.01")


@query(f"{RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id, duration_s, frame_size, fps, bitrate_kbps, audio_kbps, audio_rate, hdr_rank, is_image ORDER BY path) AS rn FROM ranked) SELECT group_id, path FROM r WHERE rn > 1")
def select_identical(spark, d):
    return ranking.select_identical(D.ranked_items(spark, d), with_size=False).select("group_id", "path")


@query(f"{RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY date_created DESC, path) AS rn FROM ranked) SELECT group_id, path FROM r WHERE rn > 1")
def select_but_newest(spark, d):
    return ranking.select_but_one(D.ranked_items(spark, d), newest=True).select("group_id", "path")


def _percent_sql(c: str, best: str) -> str:
    x = f"(({c} - {best}) * 100.0 / {best})"
    return f"CASE WHEN {best} = 0 OR abs{x} < 0.5 THEN '=' ELSE CASE WHEN {x} > 0 THEN '+' ELSE '-' END || CAST(floor(abs{x} + 0.5) AS BIGINT) || '%' END"


@query(f"{RANKED}, b AS (SELECT *, min(size) OVER w AS bs, max(bitrate_kbps) OVER w AS bb, max(duration_s) OVER w AS bd FROM ranked WINDOW w AS (PARTITION BY group_id)) SELECT group_id, path, {_percent_sql('size', 'bs')} AS size_delta, {_percent_sql('bitrate_kbps', 'bb')} AS bitrate_delta, CASE WHEN duration_s = bd THEN '=' ELSE (duration_s - bd) || 's' END AS duration_delta FROM b")
def hover_diff(spark, d):
    return ranking.hover_difference(D.ranked_items(spark, d))


@query(f"{RANKED}, b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY bitrate_kbps DESC, path) AS rn, max(size) OVER w AS ms, max(bitrate_kbps) OVER w AS mb, count(*) OVER (PARTITION BY group_id, size) AS cs, count(*) OVER (PARTITION BY group_id, bitrate_kbps) AS cb FROM ranked WINDOW w AS (PARTITION BY group_id)) SELECT group_id, path, rn = 1 AS keep_best, size = ms AND cs = 1 AS best_size, bitrate_kbps = mb AND cb = 1 AS best_bitrate FROM b")
def card_badges(spark, d):
    return ranking.card_badges(D.ranked_items(spark, d))


@query(f"{RANKED}, g AS (SELECT group_id, list(path) AS p FROM ranked GROUP BY group_id), bl AS (SELECT group_id, list(path) AS p FROM ranked WHERE group_id % 5 = 0 AND NOT (group_id % 10 = 0 AND path LIKE '%-2-%') GROUP BY group_id) SELECT g.group_id FROM g JOIN bl USING (group_id) WHERE len(list_filter(g.p, lambda x: NOT list_contains(bl.p, x))) = 0")
def blacklisted_groups(spark, d):
    x = D.ranked_items(spark, d)
    black = x.where("group_id % 5 = 0 AND NOT (group_id % 10 = 0 AND path LIKE '%-2-%')").groupBy(F.col("group_id").alias("entry_id")).agg(F.collect_list("path").alias("paths"))
    return results.blacklisted_groups(x, black)


@query(f"{RANKED}, r AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM ranked) SELECT group_id, path FROM r WHERE n > 1")
def drop_singletons(spark, d):
    return results.drop_singletons(D.ranked_items(spark, d)).select("group_id", "path")


@query(f"{RANKED}, k AS (SELECT * FROM ranked WHERE duration_s <= 400), r AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM k) SELECT group_id, path FROM r WHERE n > 1")
def remove_items(spark, d):
    x = D.ranked_items(spark, d)
    return results.remove_items(x, x.where("duration_s > 400")).select("group_id", "path")


@query(f"{RANKED} SELECT group_id, string_agg(path, '|' ORDER BY path) FILTER (similarity < 95) AS removed, coalesce(string_agg(path, '|' ORDER BY path) FILTER (similarity >= 95), '') AS kept, count(*) FILTER (similarity < 95) AS n_removed, count(*) FILTER (similarity >= 95) AS n_kept, CAST(sum(CASE WHEN similarity < 95 THEN size ELSE 0 END) AS BIGINT) AS savings FROM ranked GROUP BY group_id HAVING count(*) FILTER (similarity < 95) > 0")
def cleanup_report(spark, d):
    x = D.ranked_items(spark, d)
    return results.cleanup_report(x, x.where("similarity < 95"))


@query(f"{RANKED} SELECT count(*) FILTER (similarity < 95) AS done, count(*) FILTER (similarity >= 95) AS failed, CAST(sum(CASE WHEN similarity < 95 THEN size ELSE 0 END) AS BIGINT) AS freed_bytes FROM ranked")
def operation_totals(spark, d):
    return results.operation_totals(D.ranked_items(spark, d).select((F.col("similarity") < 95).alias("ok"), "size"))


@query("SELECT m.c_custkey AS id, CASE WHEN count(f.c_custkey) = 0 THEN 'not_found' WHEN count(f.c_custkey) = 1 THEN 'size_only' WHEN count(*) FILTER (abs(m.t - f.t) <= 2 AND abs(m.d - f.d) <= 0.5) = 1 THEN 'resolved' WHEN count(*) FILTER (abs(m.t - f.t) <= 2 AND abs(m.d - f.d) <= 0.5) > 1 THEN 'ambiguous' ELSE 'not_found' END AS confidence FROM (SELECT c_custkey, c_custkey % 61 AS s, c_custkey % 7 AS t, CAST(c_custkey % 3 AS DOUBLE) AS d FROM customer WHERE c_custkey % 4 = 0) m LEFT JOIN (SELECT c_custkey, c_custkey % 53 AS s, c_custkey % 11 AS t, CAST(c_custkey % 3 AS DOUBLE) AS d FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 53 < 50) f USING (s) GROUP BY m.c_custkey")
def relocate(spark, d):
    c, k = D.table(spark, d, "customer"), F.col("c_custkey")
    rows = lambda m, t: [k.cast("string").alias("path"), (k % m).alias("size"), (k % t).alias("modified_s"), (k % 3).cast("double").alias("duration_s")]
    found = results.relocate_missing(c.where("c_custkey % 4 = 0").select(*rows(61, 7)), c.where("c_custkey % 4 = 1 AND c_custkey % 53 < 50").select(*rows(53, 11)))
    return found.select(F.col("path").cast("long").alias("id"), "confidence")


@query(f"{CATALOG} SELECT id, CASE WHEN starts_with(path, '/media/lib1/') THEN '/new/root/' || path[13:] ELSE path END AS path FROM catalog")
def relocate_prefix(spark, d):
    return results.relocate_prefix(D.catalog(spark, d), "/media/lib1", "/new/root/").select("id", "path")


@query(f"{RANKED}, k AS (SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, path) AS rn FROM ranked WHERE similarity >= 96) SELECT r.path, k.path AS target FROM ranked r LEFT JOIN k ON r.group_id = k.group_id AND k.rn = 1 WHERE r.similarity < 96")
def link_keeper(spark, d):
    x = D.ranked_items(spark, d)
    return results.link_keeper(x, x.where("similarity < 96"))


@query(f"{RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id, hdr_rank ORDER BY path) AS rn FROM ranked), k AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM r WHERE rn = 1) SELECT group_id, path FROM k WHERE n > 1")
def hardlink_collapse(spark, d):
    return results.collapse_hard_links(D.ranked_items(spark, d), "hdr_rank").select("group_id", "path")


_NAMED = "SELECT '/s/' || s_suppkey || '/v' || (s_suppkey % 9) || CASE WHEN s_suppkey % 7 = 0 THEN '_' || (s_suppkey % 4) ELSE '' END || '.mp4' AS path FROM supplier"


@query(
    f"""WITH ex(name) AS (VALUES ('v3.mp4'), ('v4_2.mp4'), ('v5_1.mp4')), n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM ({_NAMED})),
p AS (SELECT *, name[:-5] AS stem, row_number() OVER (PARTITION BY name ORDER BY path) - 1 + CAST(name IN (SELECT name FROM ex) AS INTEGER) AS place FROM n),
taken AS (SELECT name FROM p UNION SELECT name FROM ex),
free AS (SELECT stem, i, row_number() OVER (PARTITION BY stem ORDER BY i) AS r FROM (SELECT DISTINCT stem FROM p), range(1, 2000) t(i) WHERE stem || '_' || i || '.mp4' NOT IN (SELECT name FROM taken))
SELECT path, '/dest/' || CASE WHEN place = 0 THEN name ELSE p.stem || '_' || free.i || '.mp4' END AS target FROM p LEFT JOIN free ON free.stem = p.stem AND free.r = p.place"""
)
def destination_names(spark, d):
    """Names that are all different, beside three that exist and others that look like numbered ones."""
    k = F.col("s_suppkey")
    number = F.when(k % 7 == 0, F.concat(F.lit("_"), (k % 4).cast("string"))).otherwise("")
    p = D.table(spark, d, "supplier").select(F.concat(F.lit("/s/"), k.cast("string"), F.lit("/v"), (k % 9).cast("string"), number, F.lit(".mp4")).alias("path"))
    return results.destination_names(p, "/dest", spark.createDataFrame([("v3.mp4",), ("v4_2.mp4",), ("v5_1.mp4",)], "name string"))


@query(f"{RANKED} SELECT 'delete' AS action, path, size, CAST(NULL AS VARCHAR) AS target FROM ranked WHERE similarity = 100")
def action_plan(spark, d):
    return results.action_plan(D.ranked_items(spark, d).where("similarity = 100"), "delete")


@query(f"{RANKED} SELECT group_id, path, similarity FROM ranked WHERE group_id IN (SELECT DISTINCT group_id FROM ranked ORDER BY 1 OFFSET 50 LIMIT 25)")
def page_groups(spark, d):
    return results.page_groups(D.ranked_items(spark, d), 3, 25).select("group_id", "path", "similarity")


#: What each order sorts by, in SQL; each rises and falls.
_SORTED = {
    "size": "size", "resolution": "frame_size", "duration": "duration_s", "date": "date_created", "similarity": "similarity", "group_size": "count(*) OVER (PARTITION BY group_id)",
    "group_total": "CAST(sum(size) OVER (PARTITION BY group_id) AS BIGINT)", "group_checked": "max(CAST(is_image AS INTEGER)) OVER (PARTITION BY group_id)",
}


def _sort(name: str, value: str) -> None:
    way = "DESC" if name.endswith("desc") else ""
    lead = "max" if way else "min"

    def run(spark, d):
        return results.sorted_places(D.ranked_items(spark, d), name, "is_image").select("path", "place")

    run.__name__ = f"sort_{name}"
    query(f"{RANKED}, v AS (SELECT *, {value} AS v FROM ranked), l AS (SELECT *, {lead}(v) OVER (PARTITION BY group_id) AS lead FROM v) SELECT path, row_number() OVER (ORDER BY lead {way}, group_id, v {way}, path) - 1 AS place FROM l")(run)


for _name, _value in _SORTED.items():
    for _way in ("asc", "desc"):
        _sort(f"{_name}_{_way}", _value)


@query(f"{RANKED} SELECT path, row_number() OVER (ORDER BY group_id, path) - 1 AS place FROM ranked")
def sort_none(spark, d):
    return results.sorted_places(D.ranked_items(spark, d), None).select("path", "place")


@query(f"{RANKED} SELECT group_id, path FROM ranked WHERE group_id IN (SELECT group_id FROM ranked WHERE path LIKE '%-7-%')")
def search_groups(spark, d):
    return filters.search_groups(D.ranked_items(spark, d), "-7-").select("group_id", "path")


@query(f"{RANKED} SELECT group_id, path FROM ranked WHERE group_id IN (SELECT group_id FROM ranked WHERE path LIKE '%-77%') AND NOT is_image AND similarity BETWEEN 92 AND 99")
def view_filter(spark, d):
    return results.view_filter(D.ranked_items(spark, d), "-77", "video", 92, 99).select("group_id", "path")


@query(f"{RANKED} SELECT group_id, path FROM ranked WHERE NOT is_image AND trunc(CAST(size AS FLOAT) / CAST(1048576 AS FLOAT)) BETWEEN 1 AND 4 AND path ILIKE '%-1-%' AND NOT path ILIKE '%9' AND similarity BETWEEN 93 AND 100")
def custom_selection(spark, d):
    return filters.custom_selection(D.ranked_items(spark, d), "video", 1, 4, ("*-1-*",), ("*9",), 93, 100).select("group_id", "path")


@query(f"{RANKED}, m AS (SELECT *, size > 1000000 AND similarity < 98 AS hit FROM ranked), c AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY group_id) = count(*) OVER (PARTITION BY group_id) AS all_match FROM m) SELECT group_id, path, all_match FROM c WHERE hit")
def expression_filter(spark, d):
    return filters.expression_filter(D.ranked_items(spark, d), "size > 1000000 and similarity < 98").select("group_id", "path", "all_match")


@query(f"{RANKED} SELECT r.path FROM ranked r WHERE lower(r.path) IN (SELECT lower(path) FROM ranked WHERE similarity = 97)")
def path_lookup(spark, d):
    x = D.ranked_items(spark, d)
    return results.lookup_paths(x, x.where("similarity = 97").select(F.upper("path").alias("path"))).select("path")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id, user_id LIMIT 20")
def recent_audit(spark, d):
    return results.recent(D.table(spark, d, "events").select("ts", "event_id", "user_id"), 20).select("event_id", "ts")


#: Ranked items with what exports tell besides.
TOLD = f"""{RANKED}, told AS (SELECT *, CASE WHEN duration_s % 3 = 0 THEN 'h264' END AS format, CASE WHEN bitrate_kbps % 2 = 0 THEN 'aac, stereo' END AS audio_format, CASE WHEN fps = 24 THEN 2 ELSE 0 END AS flags, CASE WHEN fps = 27 THEN duration_s * 30 ELSE 0 END AS offset_s FROM ranked)"""


def _told(spark, d):
    x = D.ranked_items(spark, d)
    audio = F.when(F.col("bitrate_kbps") % 2 == 0, "aac, stereo")
    return x.withColumns({"format": F.when(F.col("duration_s") % 3 == 0, "h264"), "audio_format": audio, "flags": F.when(F.col("fps") == 24, 2).otherwise(0), "offset_s": F.when(F.col("fps") == 27, F.col("duration_s") * 30).otherwise(0)})


_QUOTED = "CASE WHEN audio_format IS NULL THEN '' ELSE '\"' || audio_format || '\"' END"
_BOOL = "CASE WHEN {} THEN 'True' ELSE 'False' END"
_CLOCK = "printf('%02d:%02d:%02d', CAST({0} AS BIGINT) // 3600, CAST({0} AS BIGINT) % 3600 // 60, CAST({0} AS BIGINT) % 60)"


@query(
    f"""{TOLD} SELECT group_id, path, concat_ws(',', group_id, printf('%.1f', CAST(similarity AS DOUBLE)), path, size, printf('%.3f', CAST(duration_s AS DOUBLE)), frame_size, coalesce(format, ''), printf('%.2f', CAST(fps AS DOUBLE)), bitrate_kbps, {_QUOTED},
strftime(date_created, '%Y-%m-%dT%H:%M:%S.%f'), {_BOOL.format('is_image')}, flags, offset_s) AS line FROM told"""
)
def csv_export(spark, d):
    return files.csv_lines(_told(spark, d)).select("group_id", "path", "line")


@query(
    f"""{TOLD} SELECT group_id, path, concat_ws(',', group_id, path, size, {_CLOCK.format('duration_s')}, frame_size, fps, bitrate_kbps, {_QUOTED}, audio_rate, similarity, strftime(date_created, '%Y-%m-%d %H:%M:%S'), {_BOOL.format('is_image')}, {_BOOL.format('similarity = 97')}) AS line FROM told"""
)
def sheet_export(spark, d):
    x = _told(spark, d)
    return files.sheet_lines(x, x.where("similarity = 97"))


@query(f"{RANKED} SELECT group_id, path, size, CAST(similarity AS DOUBLE) AS similarity, is_image FROM ranked")
def results_json(spark, d):
    """Groups as JSON documents, read back."""
    x = D.ranked_items(spark, d)
    docs = files.results_json(x.select("group_id", F.col("group_id").alias("groupId"), "path", F.col("size").alias("sizeLong"), F.col("similarity").cast("double").alias("similarity"), F.col("is_image").alias("isImage")))
    return files.read_results(docs, "json")


@query(
    f"""{TOLD}, b AS (SELECT *, {_FIRST} AS im FROM told), c AS (SELECT *, (NOT im AND bitrate_kbps = max(bitrate_kbps) OVER w) OR frame_size = max(frame_size) OVER w AS best FROM b WINDOW w AS (PARTITION BY group_id)),
g AS (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY group_id) AS no FROM told GROUP BY group_id)
SELECT CAST(NULL AS BIGINT) AS group_id, 0 AS place, printf('Found %d duplicate group(s), %d total file(s).', (SELECT count(*) FROM g), (SELECT count(*) FROM told)) AS line UNION ALL SELECT NULL, 1, '' UNION ALL
SELECT group_id, 0, printf('Group %d (%d files):', no, n) FROM g UNION ALL SELECT group_id, CAST(n + 1 AS INTEGER), '' FROM g UNION ALL
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, path) AS INTEGER), printf('  %6.1f%%  ', CAST(similarity AS DOUBLE)) || path || CASE WHEN best THEN ' [best]' ELSE '' END || CASE WHEN offset_s > 0 THEN ' [partial clip @ ' || {_CLOCK.format('offset_s')} || ']' ELSE '' END
  || chr(10) || '         ' || frame_size || ', ' || coalesce(format, '?') || CASE WHEN is_image THEN '' ELSE printf(', %.2f fps, ', CAST(fps AS DOUBLE)) || bitrate_kbps || ' kbps, ' || {_CLOCK.format('duration_s')} END FROM c"""
)
def text_report(spark, d):
    return files.text_report(_told(spark, d))


# --- selections and counters -------------------------------------------------------------------------------

_FULL = "size, duration_s, frame_size, fps, bitrate_kbps, audio_kbps, audio_rate, hdr_rank, is_image"


def _custom(name: str, identity: int, date_order: int, take: str, order: str) -> None:
    def run(spark, d):
        x = D.ranked_items(spark, d).where("duration_s >= 50")
        return ranking.select_custom(x, identity, date_order, x.where("similarity = 90 AND duration_s > 450")).select("group_id", "path")

    run.__name__ = f"select_custom_{name}"
    query(
        f"""{RANKED}, k AS (SELECT * FROM ranked WHERE duration_s >= 50), v AS (SELECT *, ROW({_FULL}) AS me, ROW({_FULL.replace('size, ', '', 1)}) AS mine FROM k WHERE group_id NOT IN (SELECT group_id FROM k WHERE similarity = 90 AND duration_s > 450)),
h AS (SELECT *, first_value(me) OVER w AS full_, first_value(mine) OVER w AS most, first_value(path) OVER w AS head FROM v WINDOW w AS (PARTITION BY group_id ORDER BY path)),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}path) AS rn FROM h WHERE path = head OR {take}) SELECT group_id, path FROM r WHERE rn > 1"""
    )(run)


_custom("group", 0, 2, "true", "date_created DESC, ")
_custom("equal", 1, 0, "me = full_", "")
_custom("equal_but_size", 2, 1, "mine = most", "date_created, ")
_custom("unequal", 3, 0, "(me <> full_ OR mine <> most)", "")


@query(f"{CATALOG} SELECT id FROM catalog WHERE NOT on_disk")
def select_missing(spark, d):
    c = D.catalog(spark, d)
    return results.select_missing(c, c.where("on_disk")).select("id")


@query(f"{RANKED} SELECT group_id, path, similarity <> 97 AS checked FROM ranked")
def invert_checked(spark, d):
    x = D.ranked_items(spark, d)
    return results.invert_checked(x, x.where("similarity = 97")).select("group_id", "path", "checked")


@query(f"{RANKED} SELECT group_id, path, false AS checked FROM ranked")
def clear_checked(spark, d):
    return results.clear_checked(D.ranked_items(spark, d)).select("group_id", "path", "checked")


@query(f"{TOLD} SELECT path, size AS size_bytes, duration_s AS duration_seconds, frame_size, fps, bitrate_kbps AS bitrate_kbs, format, audio_format, audio_rate AS audio_sample_rate, audio_kbps AS audio_bitrate_kbs, similarity, date_created, is_image, flags, offset_s AS partial_clip_offset_seconds, group_id FROM told")
def project_items(spark, d):
    return results.project_items(_told(spark, d))


@query(f"{CATALOG} SELECT id FROM catalog WHERE contains(lower(path), 'brand_2')")
def catalog_search(spark, d):
    return results.catalog_search(D.catalog(spark, d), " BRAND_2 ").select("id")


@query(
    f"""{ITEMS}, p AS (SELECT a.is_image = b.is_image AS g1, {_DIST} <= 32 AS g2, a.is_image OR abs(a.duration_s - b.duration_s) <= least(a.duration_s * 0.2, b.duration_s * 0.2) AS g3, b.size BETWEEN trunc(a.size * 0.5) AND trunc(a.size * 1.5) AS g4,
least(a.width, b.width) >= greatest(a.width, b.width) // 2 AND least(a.height, b.height) >= greatest(a.height, b.height) // 2 AS g5, a.file_id <> b.file_id AS g7 FROM items a JOIN items b ON a.id < b.id AND NOT a.is_image AND NOT b.is_image WHERE {_TOL.replace('0.05', '0.1')})
SELECT count(*) AS pairs, count(*) FILTER (g1) AS after_kind, count(*) FILTER (g1 AND g2) AS after_quick, count(*) FILTER (g1 AND g2 AND g3) AS after_duration, count(*) FILTER (g1 AND g2 AND g3 AND g4) AS after_size, count(*) FILTER (g1 AND g2 AND g3 AND g4 AND g5) AS after_resolution,
count(*) FILTER (g1 AND g2 AND g3 AND g4 AND g5) AS after_folder, count(*) FILTER (g1 AND g2 AND g3 AND g4 AND g5 AND g7) AS after_hard_link FROM p"""
)
def gate_counters(spark, d):
    return diagnostics.gate_counters_within(D.items(spark, d), ScanConfig(duration_percent=10.0), CONFIG)


@query(f"{VIDEOS} SELECT count(*) AS n, CAST(min(len(fp)) AS INTEGER) AS shortest, CAST(max(len(fp)) AS INTEGER) AS longest FROM videos")
def fingerprint_lengths(spark, d):
    return diagnostics.fingerprint_lengths(videos(spark, d))


@query("SELECT CAST(CASE WHEN v <= 10 THEN 0 WHEN v <= 100 THEN 1 WHEN v <= 500 THEN 2 ELSE 3 END AS INTEGER) AS bucket, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT CAST(floor(value) AS BIGINT) AS v FROM events WHERE value IS NOT NULL) GROUP BY 1")
def metric_histogram(spark, d):
    return diagnostics.histogram(D.table(spark, d, "events").withColumn("v", F.floor("value").cast("long")), "v", [10, 100, 500])


# --- catalog -----------------------------------------------------------------------------------------------

_LISTED = "listed AS (SELECT id, path, folder, CASE WHEN id % 10 = 3 THEN file_size + 1 ELSE file_size END AS file_size, version FROM catalog WHERE id % 2 = 1 UNION ALL SELECT id + 5000000, path || '.new', folder, file_size, version FROM catalog WHERE id % 20 = 0)"


@query(f"{CATALOG}, {_LISTED} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL OR (o.file_size = n.file_size AND o.version = n.version) THEN 'kept' ELSE 'replaced' END AS state, CASE WHEN n.path IS NULL THEN o.file_size ELSE n.file_size END AS file_size, CASE WHEN o.path IS NOT NULL AND (n.path IS NULL OR (o.file_size = n.file_size AND o.version = n.version)) THEN o.flags END AS flags FROM catalog o FULL JOIN listed n ON o.path = n.path")
def catalog_upsert(spark, d):
    c = D.catalog(spark, d)
    seen = c.where("id % 2 = 1").withColumn("file_size", F.when(F.col("id") % 10 == 3, F.col("file_size") + 1).otherwise(F.col("file_size")))
    new = c.where("id % 20 = 0").withColumns({"id": F.col("id") + 5_000_000, "path": F.concat("path", F.lit(".new"))})
    listed = seen.unionByName(new).select("id", "path", "folder", "file_size", "version")
    return C.upsert(c, listed, ["file_size", "version"]).select("path", "state", "file_size", "flags")


@query(f"{CATALOG} SELECT id FROM catalog WHERE on_disk AND flags & 12 = 0")
def clean_catalog(spark, d):
    return C.clean(D.catalog(spark, d)).select("id")


@query(f"{CATALOG} SELECT id, path FROM catalog WHERE version % 3 = 0")
def dirty_rows(spark, d):
    return C.dirty_rows(D.catalog(spark, d).withColumn("dirty", F.col("version") % 3 == 0)).select("id", "path")


@query(f"{CATALOG} SELECT path, CASE WHEN id % 4 = 0 THEN version + 1 ELSE version END AS version FROM catalog")
def compact_catalog(spark, d):
    c = D.catalog(spark, d).select("path", "id", "version")
    return C.compact(c, c.where("id % 4 = 0").withColumn("version", F.col("version") + 1)).select("path", "version")


@query(f"{CATALOG} SELECT id, path FROM catalog WHERE folder NOT IN (SELECT folder FROM catalog WHERE id % 100 = 0)")
def delete_paths(spark, d):
    c = D.catalog(spark, d)
    gone = c.where("id % 100 = 0").select("folder").distinct()
    return C.delete_paths(c, c.join(gone, "folder", "left_semi").select("path")).select("id", "path")


@query(f"{CATALOG} SELECT id, flags & ~16 AS flags FROM catalog")
def forget_image_hashes(spark, d):
    return C.forget_image_hashes(D.catalog(spark, d)).select("id", "flags")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrivals_per_window(spark, d):
    return S.arrivals_per_window(D.table(spark, d, "events")).select(F.col("w.start").alias("start"), "event_type", "n")


@query()
def synthetic_catalog(spark, d):
    """A catalog with a row for each part, every tenth a copy of the one before it."""
    return files.generate_catalog(spark, copies_every=10, ids=D.table(spark, d, "part").select(F.col("p_partkey").alias("id")))


# --- small operators ---------------------------------------------------------------------------------------


def _scratch(name: str) -> str:
    from uuid import uuid4

    return f"{name}-{uuid4().hex}"


@query(f"{CATALOG} SELECT id, CASE WHEN flags & 2 <> 0 THEN 'manually excluded' WHEN flags & 16 <> 0 THEN 'too dark' WHEN flags & 8 <> 0 THEN 'metadata error' WHEN flags & 4 <> 0 THEN 'thumbnail error' WHEN NOT on_disk THEN 'missing' END AS reason FROM catalog")
def enumeration_reasons(spark, d):
    return filters.with_reason(D.catalog(spark, d), ScanConfig(whole_catalog=True), enumeration=True).select("id", "reason")


@query(
    """WITH c AS (SELECT p_partkey AS id, 'p' || p_partkey AS path, CAST(p_size * 7 AS DOUBLE) AS duration_s, p_partkey % 6 = 5 AS is_image, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 0 END AS flags FROM part),
a AS (SELECT DISTINCT path, unnest(CASE WHEN is_image THEN [CAST(0 AS BIGINT)] ELSE list_transform([0.25, 0.5, 0.75], lambda x: CAST(round(least(duration_s, 120.0) * x * 1000000) AS BIGINT)) END) AS at_us FROM c WHERE flags & 12 = 0),
f AS (SELECT path, unnest(CASE WHEN id % 3 = 0 THEN [CAST(round(duration_s * 500000) AS BIGINT), CAST(round(duration_s * 250000) AS BIGINT)] ELSE [CAST(0 AS BIGINT)] END) AS at_us FROM c WHERE id % 2 = 0)
SELECT path, at_us FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = a.path AND f.at_us = a.at_us)"""
)
def missing_positions(spark, d):
    """What a scan of three positions within two minutes must still decode, after one of two positions of some files without a limit."""
    k = F.col("p_partkey")
    c = D.table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("path"), (F.col("p_size") * 7).cast("double").alias("duration_s"), (k % 6 == 5).alias("is_image"), F.when(k % 11 == 0, 4).otherwise(0).alias("flags"))
    at = lambda x: F.round(F.col("duration_s") * x).cast("long")
    known = c.where("id % 2 = 0").select("path", F.explode(F.when(F.col("id") % 3 == 0, F.array(at(500_000), at(250_000))).otherwise(F.array(F.lit(0).cast("long")))).alias("at_us"))
    return adapters.missing_positions(c, known, ScanConfig(positions=3, max_sampling_s=120.0))


@query(f"{CATALOG} SELECT id, flags & 4 <> 0 AS skipped, false AS retried, id % 3 <> 0 AND id % 5 <> 0 AS whole FROM catalog")
def gathering(spark, d):
    c = D.catalog(spark, d)
    frames = F.array(F.when(F.col("id") % 3 != 0, F.col("id")), F.when(F.col("id") % 5 != 0, F.col("id")))
    return c.select("id", filters.gather_skip(ScanConfig()).alias("skipped"), filters.gather_skip(ScanConfig(retry_errors=True)).alias("retried"), filters.complete(frames).alias("whole"))


@query(f"{CATALOG}, n AS (SELECT id, ['/mnt/', '/home/u/', '//host/share/', '/srv/', 'C:/'][CAST(id % 5 + 1 AS INTEGER)] || id AS path FROM catalog) SELECT id, id % 5 IN (0, 2, 3) AS network FROM n")
def network_paths(spark, d):
    prefix = F.get(F.array(*(F.lit(x) for x in ("/mnt/", "/home/u/", "//host/share/", "/srv/", "C:/"))), (F.col("id") % 5).cast("int"))
    return D.catalog(spark, d).select("id", filters.network_path(F.concat(prefix, F.col("id").cast("string"))).alias("network"))


@query("SELECT p_partkey, CASE WHEN (p_partkey % 7 + 1) * 480 >= (p_partkey % 5 + 1) * 480 THEN 0 ELSE 2 END AS video, CASE WHEN p_partkey % 3 >= p_partkey % 4 THEN 1 ELSE 3 END AS audio FROM part")
def best_streams(spark, d):
    k = F.col("p_partkey")
    stream = lambda i, kind, width, channels: F.struct(F.lit(i).alias("index"), F.lit(kind).alias("codec_type"), width.alias("width"), F.lit(480).alias("height"), channels.alias("channels"))
    none = F.lit(0).cast("long")
    streams = F.array(stream(0, "video", k % 7 + 1, none), stream(1, "audio", none, k % 3), stream(2, "video", k % 5 + 1, none), stream(3, "audio", none, k % 4))
    p = D.table(spark, d, "part").select("p_partkey", streams.alias("s"))
    return p.select("p_partkey", filters.best_stream(F.col("s"), "video")["index"].alias("video"), filters.best_stream(F.col("s"), "audio")["index"].alias("audio"))


@query(f"{RANKED}, g AS (SELECT count(*) AS n, sum(size) AS t, max(size) AS m FROM ranked GROUP BY group_id) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(t) AS BIGINT) AS total_bytes, CAST(sum(t - m) AS BIGINT) AS savings FROM g")
def results_totals_singletons(spark, d):
    return results.totals(D.ranked_items(spark, d), singletons=True)


_ENTRIES = "e AS (SELECT group_id AS entry_id, path FROM ranked WHERE group_id % 7 = 0), gone AS (SELECT DISTINCT entry_id FROM e WHERE path LIKE '%-3-%')"


@query(f"{RANKED}, {_ENTRIES} SELECT DISTINCT entry_id FROM e WHERE entry_id NOT IN (SELECT entry_id FROM gone)")
def prune_blacklist(spark, d):
    x = D.ranked_items(spark, d)
    black = x.where("group_id % 7 = 0").groupBy(F.col("group_id").alias("entry_id")).agg(F.collect_list("path").alias("paths"))
    return results.prune_blacklist(black, x.where("path NOT LIKE '%-3-%'")).select("entry_id")


@query(f"{RANKED}, r AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM ranked WHERE group_id NOT IN (1, 2, 3)) SELECT group_id, path FROM r WHERE n > 1")
def not_a_match(spark, d):
    x = D.ranked_items(spark, d)
    items, _ = results.not_a_match(x, spark.createDataFrame([], "entry_id string, paths array<string>"), [1, 2, 3])
    return items.select("group_id", "path")


@query(f"{CATALOG} SELECT path FROM catalog WHERE id % 2 = 0 OR id % 3 = 0")
def union_roots(spark, d):
    c = D.catalog(spark, d)
    return C.union_roots(c.where("id % 2 = 0"), c.where("id % 3 = 0")).select("path")


@query(f"{CATALOG} SELECT id, CASE WHEN id = 5 THEN '/new/name' ELSE path END AS path, CASE WHEN id = 7 THEN flags | 2 ELSE flags END AS flags FROM catalog")
def catalog_edits(spark, d):
    """One path renamed, one excluded by hand."""
    c = D.catalog(spark, d)
    named = lambda k: F.col("id") == k
    return C.exclude_path(C.rename(c, named(5), "/new/name"), named(7)).select("id", "path", "flags")


@query(f"{CATALOG} SELECT id, path, version FROM catalog UNION ALL SELECT id, path, version FROM catalog WHERE version % 3 = 0")
def catalog_round_trip(spark, d):
    """A snapshot, appended dirty rows, read again; once more as JSON."""
    at = _scratch(grouping.scratch(spark) + "/catalog")
    c = D.catalog(spark, d).select("id", "path", "version")
    C.save(c, at)
    C.append_dirty(c.withColumn("dirty", F.col("version") % 3 == 0), at)
    C.export_json(C.load(spark, at), at + ".json")
    return C.import_json(spark, at + ".json", c.schema)


@query(f"{CATALOG} SELECT id, id + 1 AS second_frame FROM catalog WHERE version = 5")
def late_features(spark, d):
    """A light scan finds the rows, their features are fetched after it."""
    c = D.catalog(spark, d).withColumn("frames", F.array(F.col("id"), F.col("id") + 1))
    found = C.light(c).where("version = 5")
    return found.select("id", "path").join(C.heavy_of(c, found), "path").select("id", F.get("frames", F.lit(1)).alias("second_frame"))


@query(f"{CATALOG}, b AS (SELECT string_split(path[12:], '/') AS s FROM catalog WHERE starts_with(path, '/media/lib1/')) SELECT s[2] AS name, len(s) > 2 AS is_folder, count(*) AS files FROM b GROUP BY ALL")
def browse_folder(spark, d):
    return C.browse(D.catalog(spark, d), "/media/lib1", ("/media",))


@query(f"{RANKED} SELECT group_id, path, size, CAST(similarity AS DOUBLE) AS similarity, is_image FROM ranked")
def results_saved(spark, d):
    """Results written as compressed JSON and loaded again."""
    at = _scratch(grouping.scratch(spark) + "/results")
    files.save_results(D.ranked_items(spark, d), at)
    return files.load_results(spark, at)


@query("SELECT event_id, CAST(event_id % 3600 AS DOUBLE) * 0.25 AS at_s, least(CAST(event_id % 3600 AS DOUBLE), 30.0) * 0.5 AS early_s, CASE WHEN event_id % 50 = 0 THEN NULL ELSE 100.0 / (event_id % 50) * (50 - event_id % 50) END AS eta_s, (event_id % 50) * 100.0 / 50 AS percent FROM events")
def sampling_times(spark, d):
    t, done = (F.col("event_id") % 3600).cast("double"), F.col("event_id") % 50
    return D.table(spark, d, "events").select("event_id", K.sample_time(t, 0.25).alias("at_s"), K.sample_time(t, 0.5, 30.0).alias("early_s"), K.eta_seconds(F.lit(100.0), done, F.lit(50)).alias("eta_s"), K.progress(done, F.lit(50)).alias("percent"))


@query(
    f"""{VIDEOS}, both_ AS (SELECT a.id AS source_id, b.id AS clip_id, a.fp AS x, b.fp AS y, b.duration_s / a.duration_s AS ratio, len(b.fp) < len(a.fp) AS length_ok FROM videos a JOIN videos b ON b.id % 2 = 1 AND (a.id = b.id - 1 OR a.id = b.id - 7)),
places AS (SELECT *, unnest(range(0, len(x) - len(y) + 1)) AS o FROM both_), differ AS (SELECT *, list_sum(list_transform(range(1, len(y) + 1), lambda i: bit_count(xor(y[i], x[i + o])))) AS bits FROM places),
ranks AS (SELECT *, row_number() OVER (PARTITION BY source_id, clip_id ORDER BY bits, o) AS rn, ratio >= 0.1 AND ratio < 0.95 AS ratio_ok, bits <= floor(CAST(CAST(1 AS FLOAT) - CAST(0.8 AS FLOAT) AS FLOAT) * len(y) * 32) AS similarity_ok FROM differ)
SELECT source_id, clip_id, round(ratio, 6) AS ratio, ratio_ok, true AS duration_ok, length_ok, round(1.0 - bits / (len(y) * 32), 6) AS similarity, CAST(o AS INTEGER) AS offset_s, similarity_ok,
  CASE WHEN ratio_ok AND length_ok AND similarity_ok THEN 'clip' ELSE 'no clip: ' || concat_ws(', ', CASE WHEN NOT ratio_ok THEN 'ratio' END, CASE WHEN NOT length_ok THEN 'length' END, CASE WHEN NOT similarity_ok THEN 'similarity' END) END AS verdict FROM ranks WHERE rn = 1"""
)
def explain_clips(spark, d):
    """Every clip with its own source and with the one three before it."""
    x = videos(spark, d)
    s = F.struct("id", "duration_s", "fp")
    clips = x.where("id % 2 = 1").select(s.alias("c"))
    both = x.select(s.alias("s")).join(clips.select("c", F.explode(F.array(F.col("c.id") - 1, F.col("c.id") - 7)).alias("k")), F.col("s.id") == F.col("k"))
    return diagnostics.explain_clip(both).withColumn("similarity", F.round("similarity", 6))


@query(f"{RANKED} SELECT group_id, path, size, CAST(similarity AS DOUBLE) AS similarity, is_image, CASE WHEN is_image THEN NULL ELSE 'picture ' || size % 97 END AS picture FROM ranked")
def results_bundle(spark, d):
    """Results and their thumbnails written as a bundle, and read back by the thumbnails' keys; many videos have equal pictures."""
    at = _scratch(grouping.scratch(spark) + "/bundle")
    x = D.ranked_items(spark, d)
    key = bundle.thumb_key(F.col("path"), F.lit(0.0), F.lit(100), F.lit(90)).alias("key")
    picture = F.concat(F.lit("picture "), (F.col("size") % 97).cast("string")).cast("binary")
    bundle.save_bundle(x, x.where("NOT is_image").select(key, picture.alias("picture")), at)
    items, thumbs = bundle.load_bundle(spark, at)
    return items.withColumn("key", key).join(thumbs, "key", "left").drop("key").withColumn("picture", F.col("picture").cast("string"))


# --- undo ---------------------------------------------------------------------------------------------------


def _stack(keep: int) -> str:
    """SQL that keeps a stack of the steps of each user, one event after another: errors are undos."""
    return f"""e AS (SELECT user_id AS u, event_id AS s, event_type = 'error' AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT u, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS popped FROM e
  UNION ALL SELECT e.u, e.i, CASE WHEN e.undo THEN r.stack[1:len(r.stack) - 1] ELSE list_append(r.stack, e.s)[greatest(1, len(r.stack) + 2 - {keep}):] END, CASE WHEN e.undo THEN r.stack[len(r.stack)] END FROM r JOIN e ON e.u = r.u AND e.i = r.i + 1)"""


def _log(spark, d):
    """Every event is a step of its user that sets one or two paths; errors are undos."""
    k = F.col("event_id")
    name = lambda m: F.concat(F.lit("p"), (k % m).cast("string"))
    paths = F.when(F.col("event_type") == "error", F.array(F.lit(None).cast("string"))).otherwise(F.array(name(10), name(7)))
    return D.table(spark, d, "events").select(F.col("user_id").alias("session"), k.alias("seq"), F.explode(F.array_distinct(paths)).alias("path"), (k % 3 != 0).alias("checked"))


@query(f"WITH RECURSIVE {_stack(3)} SELECT e.u AS user_id, e.s AS event_id, e.undo, e.s IN (SELECT popped FROM r WHERE popped IS NOT NULL) AS undone FROM e")
def undo_short_memory(spark, d):
    """Which steps were taken back where a user's last three can be."""
    return SEL.steps(_log(spark, d), 3).select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), "undo", "undone")


@query(
    f"""WITH RECURSIVE {_stack(SEL.STEPS)}, l AS (SELECT u, s, unnest(list_distinct(['p' || s % 10, 'p' || s % 7])) AS path FROM e WHERE NOT undo AND s NOT IN (SELECT popped FROM r WHERE popped IS NOT NULL))
SELECT u AS user_id, path, max(s) % 3 <> 0 AS checked FROM l GROUP BY u, path"""
)
def selection_after_undo(spark, d):
    """What every user's log leaves checked."""
    return SEL.selected(_log(spark, d)).withColumnRenamed("session", "user_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
