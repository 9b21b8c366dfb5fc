"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, remove, semi, written

#: Word offsets that a seed compares; the offsets between them are ignored. Together the four find every
#: alignment of 5 or more words of which a share of 0.8 agree (tests try patterns).
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: Items of fewer words have no room for a word that differs, so they are found by seeds of all their words.
SHORT = 5
#: Test seeds beyond which they are shuffled, not broadcast (some 100 bytes each).
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words (runs of letters and digits, lower-cased); null: none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks, keep: list[str], whole: list[int]) -> DataFrame:
    """keep, i, key: a row for each place and mask of the array h, and for each place and number of words in ``whole``; key is null where it doesn't fit."""
    first = min([max(m) for m in masks] + [n - 1 for n in whole])
    places = df.select(*keep, "h", F.explode(F.when(F.size("h") > first, F.sequence(F.lit(0), F.size("h") - 1 - first))).alias("i"))
    at = lambda o: F.get("h", F.col("i") + o)
    all_of = [*masks, *(tuple(range(n)) for n in whole)]
    names = [*range(len(masks)), *(1000 + n for n in whole)]
    keys = [F.when(F.col("i") + max(m) < F.size("h"), F.xxhash64(F.lit(k), *(at(o) for o in m))) for k, m in zip(names, all_of)]
    return places.select(*keep, "i", F.explode(F.array(*keys)).alias("key")).where(F.col("key").isNotNull())


def contaminated(docs: DataFrame, tests: DataFrame, similarity: float = 0.8, masks=MASKS, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, doc_word, n_words, n_match, similarity): test items that documents hold.

    An item is held if, laid over the document at one place without gaps, at least ``similarity`` of its words agree
    (all of them, if it has fewer than five); places that reach over the document's ends count what lies inside. The
    best place is told, the first of equals. Seeds of test items meet the documents' seeds in one stage with the scan
    when they are few (counted first); else both are shuffled by seed. Places are made distinct before any words are
    fetched, so text that repeats a word (also very long) costs its distinct places only. Null and empty items and
    documents match nothing; repeated ids count as one; ties go to the first place; an empty table gives an empty
    result; other columns are ignored. The masks hold for a similarity of 0.8 or more; a lower one is an error.
    """
    if not 0.8 <= similarity <= 1.0:
        raise ValueError("similarity must be from 0.8 to 1: the masks don't find less")
    items = tests.select(F.col(item).alias("item_id"), word_hashes(F.col(item_text)).alias("h")).where(F.size("h") > 0)
    items, _ = written(items.withColumn("u", F.xxhash64("item_id", "h")).dropDuplicates(["u"]), "items")
    whole = sorted(r["n"] for r in items.select(F.size("h").alias("n")).where(F.col("n") < SHORT).distinct().collect())  # four numbers at the most
    long = _seeds(items.where(F.size("h") >= SHORT), masks, ["u"], [])
    short = [_seeds(items.where(F.size("h") == n), [], ["u"], [n]) for n in whole]
    for x in short:
        long = long.unionByName(x)
    seeds, at_seeds = written(long.join(items.select("u", F.size("h").alias("n")), "u").select("key", "u", F.col("i").alias("j"), "n"), "seeds")
    rows = docs.select(F.col(key).alias("doc_id"), word_hashes(F.col(text)).alias("h"))
    few = seeds.count() <= broadcast_seeds
    own = _seeds(rows, masks, ["doc_id"], whole)
    found = own.join(F.broadcast(seeds) if few else seeds, "key").select("doc_id", "u", (F.col("i") - F.col("j")).alias("at"), "n").distinct()
    found, _ = written(found, "places")
    remove(docs.sparkSession, at_seeds)
    # words are read again for documents with a place only
    of, held = fresh(docs, "d"), found.select("doc_id").distinct()
    held, _ = written(held.withColumnRenamed("doc_id", of), "held")
    small = held.count() <= broadcast_seeds
    match = F.col(key).eqNullSafe(F.col(of))
    named = docs.join(F.broadcast(held) if small else held, match, "left_semi").select(F.col(key).alias("_d"), word_hashes(F.col(text)).alias("h"))
    hits = found.join(named, F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "u", "at", "n", "h")
    # the document's words under the item: nothing before its first word, what is beyond its end is missing
    window = F.slice("h", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(F.col("n") + F.least(F.col("at"), F.lit(0)), F.lit(0)))
    hits = hits.select("doc_id", "u", "at", "n", window.alias("w"))
    known = items.select("u", "item_id", F.col("h").alias("t"))
    hits = hits.join(F.broadcast(known) if few else known, "u")
    under = F.slice("t", F.greatest(-F.col("at"), F.lit(0)) + 1, F.col("n"))
    same = F.aggregate(F.zip_with("w", under, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    hits = hits.select("doc_id", "item_id", "n", F.struct(same.alias("m"), (-F.col("at")).alias("b"), (-F.col("n")).alias("c")).alias("best"))
    hits = hits.where(F.col("best.m") >= F.lit(similarity) * F.col("n"))
    best = hits.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    n = -F.col("best.c")
    return best.select("doc_id", "item_id", (-F.col("best.b")).alias("doc_word"), n.alias("n_words"), F.col("best.m").alias("n_match"), F.round(F.col("best.m") / n, 6).alias("similarity"))


def decontaminate(docs: DataFrame, tests: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a test item; clean rows stay as they are, with all columns.

    Each row is judged by its own text, known by two 64-bit hashes, so rows with a null key or a key that others
    share go or stay by themselves. Null and empty texts stay, copies go together, an empty table gives an empty
    result.
    """
    name = fresh(docs, "t")
    own = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))
    named = docs.withColumn(name, own)
    bad = contaminated(named.select(F.col(name).alias("t"), F.col(text).alias("text")), tests, key="t", **options)
    return semi(named, bad.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


#: The same by comparing every word of every document with every word of every item (small tables).
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
tw AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j FROM t ),
m AS (SELECT doc_id, item_id, n, i - j AS place, count(*) AS m FROM dw JOIN tw USING (x) GROUP BY ALL HAVING count(*) >= 0.8 * n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, place) AS k FROM m)
SELECT doc_id, item_id, CAST(place AS INTEGER) AS doc_word, CAST(n AS INTEGER) AS n_words, CAST(m AS INTEGER) AS n_match, round(m / n, 6) AS similarity FROM r WHERE k = 1
"""
