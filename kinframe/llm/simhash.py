"""SimHash near-duplicates: every fingerprint's half-radius ball is emitted, colliding pairs are verified.

A variant is shuffled by its first bits. A fingerprint goes once to each prefix that some of its variants have, and
the task that owns the prefix writes these variants out, so that the ball of 2081 variants (64 bits, radius 2) costs
some 80 shuffled rows instead of 2081 (for 200,000 fingerprints). How long a prefix is follows from the number of
fingerprints, and prefixes that hold more than a task should are made longer, for as many rounds as it takes.

near_copies() and one_of_each() go by the Jaccard similarity of shingle sets instead: a similarity of 0.8 is some 10
bits, which no affordable ball reaches, so pairs meet in bands of minimum hashes, and op7's links are only added to
them. Each text is held against three hubs of each of its bands first. What a band still holds of different groups is
compared in full, in blocks: sketches refuse what can't be similar, the shingle sets decide the rest there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, in_batches, parts, release, remove, semi, written

#: Fingerprints that a prefix should hold of its own, rows of a prefix beyond which it is made longer, and bits that it then gains.
OWN, MOST, STEP = 64, 8_192, 6
#: Variants that a task sorts at a time; a prefix with more is made longer too.
TOGETHER = 2_000_000
#: Bands of one_of_each() and the minimum hashes in each: two sets of similarity s share none with (1 - s^4)^20, 3e-5 at 0.8.
BANDS, BAND = 20, 4
#: Minimum hashes of a sketch, a byte each, and standard deviations below its mean at which a pair of the asked similarity is refused (1e-9).
SKETCH, DEVIATIONS = 512, 6
#: Texts of a block under a band, and shingles up to which their sets go along, so that pairs are decided there.
MET, SMALL = 256, 4096


def shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every run of ``words`` words, or of all words if they are fewer, as big-endian bytes in bounded blocks."""
    from xxhash import xxh64_digest

    w = (text or "").encode("utf-8", "replace").translate(_FOLD).split()  # splits at space and \t-\r only
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(w))
    s, e = starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    for b in range(0, len(s), 1 << 16):
        yield np.frombuffer(b"".join([xxh64_digest(joined[i:j], 42) for i, j in zip(s[b : b + (1 << 16)], e[b : b + (1 << 16)])]), dtype=np.uint8)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The signed 64-bit SimHash: a bit is 1 if it is set in over half the shingles' XXH64 (seed 42); no words: 0."""
    return _vote(list(shingles(text, words)))


def _vote(blocks: list[np.ndarray]) -> int:
    total, n = np.zeros(64, dtype=np.int64), sum(len(h) // 8 for h in blocks)
    for h in blocks:
        total += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(2 * total > n).tobytes(), dtype=">i8")[0])


def shingle_set(blocks: list[np.ndarray]) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.concatenate([h.view(">u8").astype(np.uint64) for h in blocks])) if blocks else np.empty(0, np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """A key for each band: a hash of its BAND minimum hashes; none for an empty set."""
    if not len(found):
        return []
    from xxhash import xxh64_intdigest

    mul, add = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND, 1), dtype=np.uint64)
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for b in range(0, len(found), 1 << 11):  # a matrix that fits the cache
        low = np.minimum(low, (found[b : b + (1 << 11)] * (mul | np.uint64(1)) + add).min(axis=1))
    return [xxh64_intdigest(low[i : i + BAND].tobytes(), i) - (1 << 63) for i in range(0, len(low), BAND)]


_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every whole text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": pd.Series([fingerprint(t, words) for t in b["text"]], dtype="int64")})
            release()

    kind = docs.schema[key].dataType.simpleString()
    return in_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, f"doc_id {kind}, fp long")


def _flips(bits: range, most: int) -> list[int]:
    """Masks that flip up to ``most`` of some bits, as signed longs."""
    flips = [sum(1 << b for b in c) for r in range(most + 1) for c in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in flips]


def _longer(rows: DataFrame, done: int, bits: int, half: int) -> DataFrame:
    """Rows (fp, left, prefix) whose prefix has ``done`` bits, for all prefixes of ``bits`` bits that variants have below them.

    left is how many bits may still be flipped; prefix is the variant's, in its highest bits.
    """
    more = range(64 - bits, 64 - done)
    steps = F.array(*(F.lit(_flips(more, n)) for n in range(half + 1)))
    high = sum(1 << b for b in range(64 - bits, 64))
    own = F.lit(high - (1 << 64)).cast("long")  # the highest bits
    out = rows.select("fp", "left", "prefix", F.explode(F.get(steps, F.col("left"))).alias("m"))
    low = F.lit(sum(1 << b for b in more) - ((1 << 64) if done == 0 else 0)).cast("long")
    prefix = F.col("prefix").bitwiseOR(F.col("fp").bitwiseAND(low).bitwiseXOR(F.col("m")))
    return out.select("fp", (F.col("left") - F.bit_count("m")).cast("int").alias("left"), prefix.bitwiseAND(own).alias("prefix"))


def _collisions(bits: int, half: int):
    """Over rows (fp, left, prefix) in the order of prefixes: every variant with the prefix is made, and those of several fingerprints chain them."""
    low = np.arange(64 - bits, dtype=np.uint64)
    flips = []  # masks below the prefix, by how many bits may be flipped
    for n in range(half + 1):
        masks = [np.zeros(1, dtype=np.uint64)]
        for r in range(1, n + 1):
            c = np.array(list(combinations(range(64 - bits), r)), dtype=np.int64).reshape(-1, r)
            masks.append((np.uint64(1) << low[c]).sum(axis=1, dtype=np.uint64) if len(c) else np.empty(0, dtype=np.uint64))
        flips.append(np.concatenate(masks))
    tail = np.uint64((1 << (64 - bits)) - 1)

    def chains(fp: np.ndarray, left: np.ndarray, prefix: np.ndarray) -> pd.DataFrame:
        """Links between the fingerprints of whole prefixes."""
        every, who = [], []
        for n in range(half + 1):
            at = np.flatnonzero(left == n)
            if len(at):
                every.append((((fp[at] & tail) | prefix[at])[:, None] ^ flips[n][None]).ravel())
                who.append((at, len(flips[n])))
        v = np.concatenate(every)
        order = np.sort(v)
        shared = np.unique(order[1:][order[1:] == order[:-1]])  # variants of several
        if not len(shared):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        mine = np.flatnonzero(shared[at] == v)
        owner = np.concatenate([np.repeat(at_, n) for at_, n in who])
        f, x = fp[owner[mine]].view(np.int64), at[mine]
        by = np.lexsort((f, x))
        f, x = f[by], x[by]
        same = x[1:] == x[:-1]
        return pd.DataFrame({"a": f[:-1][same], "b": f[1:][same]}).drop_duplicates()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, most = None, max(1, TOGETHER // len(flips[-1]))
        for b in it:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) < most:
                continue
            open_ = (held["prefix"] == held["prefix"].iloc[-1]).to_numpy()  # the next batch may go on with it
            if not open_.all():
                yield from parts_of(held[~open_])
                held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield from parts_of(held)
        held = b = None
        release()

    def parts_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, left, prefix = (rows[c].to_numpy() for c in ("fp", "left", "prefix"))
        heads = np.flatnonzero(np.diff(prefix, prepend=~prefix[:1]))
        cost = np.array([len(x) for x in flips])[left]
        ends, begin = [*heads[1:].tolist(), len(fp)], 0
        size = 0
        for i, j in zip(heads.tolist(), ends):  # whole prefixes, some TOGETHER variants at a time
            n = int(cost[i:j].sum())
            if size and size + n > TOGETHER:
                yield chains(fp[begin:i].view(np.uint64), left[begin:i], prefix[begin:i].view(np.uint64))
                begin, size = i, 0
            size += n
        yield chains(fp[begin:].view(np.uint64), left[begin:], prefix[begin:].view(np.uint64))

    return run


def links(fps: DataFrame, radius: int = 4, own: int | None = None, most: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all which differ in ``radius`` bits or fewer.

    Every fingerprint emits all variants within radius/2. Those that share a variant are within the radius of one
    another; per variant they are chained in sorted order, so a variant that n share gives n - 1 links, not all
    pairs. Links are made distinct and verified. radius must be even: an odd one has no half.

    Prefixes start at as many bits as leave each ``own`` fingerprints; a prefix with more than ``most`` rows or
    TOGETHER variants is cut into longer ones. No prefix of 64 bits can hold more rows than a ball, so this ends.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    own, most, half, spark = own or OWN, most or MOST, radius // 2, fps.sparkSession
    bits = min(40, max(1, (fps.count() // own).bit_length()))
    start = fps.select("fp", F.lit(half).alias("left"), F.lit(0).cast("long").alias("prefix"))
    rows, path = written(_longer(start, 0, bits, half), "prefixes")
    found, paths = [], [path]
    while True:
        balls = F.array(*(F.lit(sum(comb(64 - bits, r) for r in range(n + 1))).cast("long") for n in range(half + 1)))
        sizes = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get(balls, F.col("left"))).alias("variants"))
        large = sizes.where((F.col("n") > most) | (F.col("variants") > TOGETHER)).select("prefix")
        large, at = written(large, "large")
        paths.append(at)
        n_large = large.count() if bits < 64 else 0
        here = rows if not n_large else semi(rows, large, "prefix", "left_anti")
        dealt = here.select("fp", "left", "prefix").repartition(parts(fps), "prefix").sortWithinPartitions("prefix")
        out, _ = written(dealt.mapInPandas(_collisions(bits, half), "a long, b long"), "pairs")
        found.append(out)
        if not n_large:
            break
        after = min(64, bits + STEP)
        rows, path = written(_longer(semi(rows, large, "prefix"), bits, after, half), "prefixes")
        paths.append(path)
        bits = after
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    out, _ = written(pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius), "links")
    remove(spark, *paths)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id: smallest doc_id that links reach.

    Fingerprints with no words are zero and link like others. Null texts are empty. Rows with a null key link
    like others and keep a row, but give no id (component_id is null if no row that they reach has a key).
    Repeated rows keep their rows, other columns are ignored, an empty table gives an empty result. Equal
    fingerprints are one vertex, so copies are never paired with one another.
    """
    rows, _ = written(fingerprints(docs, words, key, text), "fingerprints")
    first, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "vertices")
    groups = components(links(first.select("fp"), radius))  # by fingerprint
    named = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("component", "fp").alias("group"))
    named, _ = written(named, "named")
    least = named.groupBy("group").agg(F.min("doc").alias("component_id"))
    vertex = named.join(least, "group").select("fp", "component_id")
    return rows.join(vertex, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _signatures(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(doc_id, t hash of the text, fp, bands) of every row."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, keys = [], []
            for x in b["text"]:
                blocks = list(shingles(x, words))
                fps.append(_vote(blocks))
                keys.append(bands(shingle_set(blocks)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "t": b["t"], "fp": pd.Series(fps, dtype="int64"), "bands": pd.Series(keys, dtype="object")})
            release()

    kind = docs.schema[key].dataType.simpleString()
    rows = in_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return rows.mapInPandas(each, f"doc_id {kind}, t long, fp long, bands array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(t, s array of the distinct shingle hashes) of rows (t, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 200):  # sets are about as large as their texts
                c = b.iloc[i : i + 200]
                yield pd.DataFrame({"t": c["t"].to_numpy(), "s": pd.Series([shingle_set(list(shingles(x, words))).view(np.int64) for x in c["text"]], dtype="object")})
            release()

    return texts.mapInPandas(each, "t long, s array<long>")


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """(t, n, sketch, s) of rows (t, text): how many shingles, SKETCH minimum hashes of them, a byte each, and the set itself if it is SMALL."""
    mul, add = np.random.default_rng(43).integers(0, 1 << 64, (2, SKETCH, 1), dtype=np.uint64)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, out, small = [], [], []
            for x in b["text"]:
                found = shingle_set(list(shingles(x, words)))
                low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
                for i in range(0, len(found), 512):
                    low = np.minimum(low, (found[i : i + 512] * (mul | np.uint64(1)) + add).min(axis=1))
                n.append(len(found))
                out.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
                small.append(found.view(np.int64) if len(found) <= SMALL else None)
            yield pd.DataFrame({"t": b["t"], "n": pd.Series(n, dtype="int64"), "sketch": pd.Series(out, dtype="object"), "s": pd.Series(small, dtype="object")})
            release()

    return texts.mapInPandas(each, "t long, n long, sketch binary, s array<long>")


def _common(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of the sorted set x each of the others has."""
    flat = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *(len(y) for y in others[:-1])]), dtype=np.int64)


def _compared(similarity: float):
    """Over rows (k, same, x, y) of a band's blocks: pairs of different groups, each where its first common band is.

    (a, b, sure): pairs of small sets that are similar, and pairs with a larger set that a sketch doesn't refuse.
    """
    p = similarity + (1 - similarity) / 256  # unlike minimum hashes may share a byte
    least = SKETCH * p - DEVIATIONS * np.sqrt(SKETCH * p * (1 - p))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, same, *sides in zip(batch["k"], batch["same"], batch["x"], batch["y"]):
                (t, c, n, bands_, sk), (t2, c2, n2, bands2, sk2) = (
                    [np.array([r["t"] for r in s]), np.array([r["c"] for r in s]), np.array([r["n"] for r in s]), np.array([r["bands"] for r in s]), np.frombuffer(b"".join([r["sketch"] for r in s]), np.uint8).reshape(len(s), -1)]
                    for s in sides
                )
                sets, sets2 = ([None if r["s"] is None else np.asarray(r["s"]).view(np.uint64) for r in s] for s in sides)
                may = (c[:, None] != c2) & (np.minimum(n[:, None], n2) >= similarity * np.maximum(n[:, None], n2))
                if same:
                    may &= t[:, None] < t2
                for e in range(int(k)):
                    may &= bands_[:, e][:, None] != bands2[:, e]
                a, b, sure = [], [], []
                for i in np.flatnonzero(may.any(axis=1)).tolist():
                    j = np.flatnonzero(may[i])
                    j = j[np.count_nonzero(sk2[j] == sk[i], axis=1) >= least]
                    small = [q for q in j.tolist() if sets[i] is not None and sets2[q] is not None]
                    if small:
                        common, q = _common(sets[i], [sets2[q] for q in small]), np.array(small)
                        good = q[common >= similarity * (n[i] + n2[q] - common)].tolist()
                    else:
                        good = []
                    large = sorted(set(j.tolist()) - set(small))
                    a += [t[i]] * (len(good) + len(large))
                    b += t2[good + large].tolist() if good or large else []
                    sure += [True] * len(good) + [False] * len(large)
                x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": np.array(sure, dtype=bool)})
            release()

    return run


def _across(keys: DataFrame, groups: DataFrame, first: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, sure): all pairs of texts that share a band, lie in different groups so far and are (or, where not sure, may be) similar.

    ``keys`` has (t, k, key). A group's members under a key go to blocks of their own if they are many, else to blocks
    that several groups share; blocks of one key meet, but not those of one group.
    """
    spark = keys.sparkSession
    named = keys.join(groups.select(F.col("node").alias("t"), F.col("component").alias("c")), "t", "left").withColumn("c", F.coalesce("c", "t"))
    members = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    wide = members.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("n") <= MET, F.col("n")).otherwise(0)).alias("few")).where("groups > 1")
    sizes, at_sizes = written(members.join(wide, "key").withColumn("own", F.col("n") > MET), "band-groups")
    named = named.join(sizes.select("key", "c", "n", "few", "own"), ["key", "c"])
    many = F.greatest(F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("few")) / MET), F.lit(1))
    block = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("t")).otherwise(F.col("c"))), many)
    # a group of few members stays together; its block may hold some more than MET
    named, at_named = written(named.select("t", "k", "key", "c", F.when(F.col("own"), F.col("c")).alias("big"), block.alias("block")), "band-texts")
    need = named.select("t").distinct()
    sketches, at_sketches = written(_sketches(semi(texts, written(need, "need")[0], "t", most=100_000).dropDuplicates(["t"]), words), "sketches")
    places = named.select("key", "big", "block").distinct()
    other = places.select("key", F.col("big").alias("big2"), F.col("block").alias("block2"))
    order = lambda big, block: F.struct(big, block)
    pairs = places.join(other, "key").where((order(F.col("big"), F.col("block")) < order(F.col("big2"), F.col("block2"))) | (F.col("big").isNull() & F.col("big2").isNull() & (F.col("block") == F.col("block2"))))
    pairs = pairs.where(F.col("big").isNull() | F.col("big2").isNull() | (F.col("big") != F.col("big2")))
    rows = named.join(sketches, "t").join(first.select("t", "bands"), "t")
    filled = rows.groupBy("key", "k", "big", "block").agg(F.collect_list(F.struct("t", "c", "n", "bands", "sketch", "s")).alias("rows"))
    filled, at_filled = written(filled, "band-blocks")
    side = lambda n, big, block: filled.select("key", F.coalesce("big", F.lit(0)).alias(f"b{n}"), F.col("big").isNull().alias(f"n{n}"), F.col("block").alias(f"o{n}"), F.col("rows").alias(n), *(["k"] if n == "x" else []))
    met = pairs.select("key", F.coalesce("big", F.lit(0)).alias("bx"), F.col("big").isNull().alias("nx"), F.col("block").alias("ox"), F.coalesce("big2", F.lit(0)).alias("by"), F.col("big2").isNull().alias("ny"), F.col("block2").alias("oy"))
    met = met.join(side("x", "big", "block"), ["key", "bx", "nx", "ox"]).join(side("y", "big2", "block2"), ["key", "by", "ny", "oy"])
    met = met.select("k", (F.col("nx") & F.col("ny") & (F.col("ox") == F.col("oy"))).alias("same"), "x", "y")
    out, _ = written(met.mapInPandas(_compared(similarity), "a long, b long, sure boolean").distinct(), "across")
    remove(spark, at_sizes, at_named, at_sketches, at_filled)
    return out


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets are similar enough; sets without shingles are alike."""
    need, at_need = written(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct(), "need")
    sets, at_sets = written(_sets(semi(texts, need, "t", most=100_000).dropDuplicates(["t"]), words), "sets")
    both = pairs.join(sets.select(F.col("t").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    edges, _ = written(both.where((union == 0) | (common >= F.lit(similarity) * union)).select("a", "b"), "edges")
    remove(pairs.sparkSession, at_need, at_sets)
    return edges


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: rows whose shingle sets have a Jaccard similarity of ``similarity`` or more are linked.

    Distinct texts are the vertices. Each is paired with three texts of every band of minimum hashes that it is in, and
    with its SimHash links within ``radius``; exact similarity decides, and what is linked forms groups. Then all
    pairs that share a band but no group are compared (see _across), so a pair is lost only if it shares no band
    (3e-5 at 0.8), however large the family that it stands in. Texts without words are alike; null texts are empty.
    component_id is the smallest doc_id that links reach (null if no row there has one); repeated rows keep theirs;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows, path = written(_signatures(docs, words, key, text), "signatures")
    first, at_first = written(rows.groupBy("t").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    keys, at_keys = written(first.select("t", F.posexplode("bands").alias("k", "band")).select("t", "k", F.xxhash64("k", "band").alias("key")), "keys")
    hub = lambda n: F.min(F.struct(F.xxhash64(F.lit(n), "t").alias("h"), F.col("t").alias("t")))["t"]
    hubs = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(F.min("t"), hub(1), hub(2)).alias("hubs")).where("n > 1")
    met = keys.join(hubs, "key").select(F.explode("hubs").alias("x"), F.col("t").alias("y")).where("x <> y")
    at = first.groupBy("fp").agg(F.min("t").alias("t"))
    ball = links(at.select("fp"), radius).join(at.select(F.col("fp").alias("a"), F.col("t").alias("x")), "a").join(at.select(F.col("fp").alias("b"), F.col("t").alias("y")), "b")
    same = first.join(at.select("fp", F.col("t").alias("x")), "fp").where("t <> x").select("x", F.col("t").alias("y"))
    found = met.unionByName(ball.select("x", "y")).unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs, at_pairs = written(found.distinct(), "pairs")
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))
    edges = _similar(pairs, texts, words, similarity)
    more = _across(keys, components(edges), first, texts, words, similarity)
    edges = edges.unionByName(more.where("sure").select("a", "b"))
    if not (large := more.where("NOT sure").select("a", "b")).isEmpty():
        edges = edges.unionByName(_similar(large, texts, words, similarity))
    groups = components(edges)
    whole = rows.select("doc_id", "t").join(groups.select(F.col("node").alias("t"), "component"), "t", "left").select("doc_id", F.coalesce("component", "t").alias("c"))
    out, _ = written(whole, "copies")
    remove(spark, path, at_first, at_keys, at_pairs)
    return out.join(out.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the smallest key of each group of near copies (Jaccard) only; all columns and rows with null keys stay."""
    found, _ = written(near_copies(docs, words, similarity, key=key, text=text).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "copies")
    return semi(docs, found, key, "left_anti")
