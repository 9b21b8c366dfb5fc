"""Long repeated byte strings, found by a logarithmic family of sparse suffix arrays.

A suffix array over every byte would be several times the text. Here an array holds only the suffixes that
start at anchors: of each run of WINDOW places the one whose KEY bytes hash lowest. Which place that is depends
on the run's content alone, and any ``length``-byte string (length = WINDOW + KEY - 1) holds such a run, so two
equal strings hold the same anchor at the same offset: no long match is missed.

An array is a table of (head, doc, pos) in the order of the suffixes' first KEY bytes. A new batch's array is
sorted, merge-scanned against each level (and itself), and becomes a level; levels of equal size are merged, so a
suffix is rewritten a logarithmic number of times. Suffixes whose head another one has are then put into their
full order, by all the bytes that a match may reach to the right, and a scan of neighbours tells how far they
agree; the same scan over what lies to the left gives, for each place that a string of ``length`` bytes may start
at, which suffixes share it. Bytes decide, not hashes. Rows with all bytes on levels would be some 800 bytes for
each 185 bytes of text, beyond what a job may write, so the levels hold heads and the bytes are fetched for the
shared ones only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, in_batches, parts, release, remove, written

#: Bytes of a suffix that order the arrays.
KEY = 32
#: Suffixes with one head that one task compares; larger groups are counted string by string, spread over the cluster.
GROUP = 100_000
#: Places that are hashed at a time, so that memory doesn't grow with a text.
BLOCK = 1 << 19

_B = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rolling(b: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on, by doubling."""
    m = len(b) - n + 1
    if m < 1:
        return np.empty(0, dtype=np.uint64)
    h, k, parts_, total = b.astype(np.uint64) + np.uint64(1), 1, [], 0
    bits = n
    while bits:
        if bits & 1:
            parts_.append((k, h))
        bits >>= 1
        if bits:
            h = h[: max(0, len(h) - k)] * np.uint64(pow(_B, k, 1 << 64)) + h[k:]
            k *= 2
    out = np.zeros(m, dtype=np.uint64)
    for k, h in parts_:  # the pieces side by side
        out = out * np.uint64(pow(_B, k, 1 << 64)) + h[total : total + m]
        total += k
    return out


def anchors(data: bytes, length: int) -> np.ndarray:
    """Places whose KEY-byte hash is the lowest (the first of equals) of some run that a length-byte string holds."""
    window, n = length - KEY + 1, len(data)
    if n < length:
        return np.empty(0, dtype=np.int64)
    b, out = np.frombuffer(data, dtype=np.uint8), []
    for start in range(0, n - length + 1, BLOCK):
        some = b[start : start + BLOCK + length - 1]
        h = _rolling(some, KEY)
        h ^= h >> np.uint64(31)
        h *= _MIX
        low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)  # places in the low 20 bits break ties
        k = 1
        while 2 * k <= window:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < window:
            low = np.minimum(low[: len(low) - (window - k)], low[window - k :])
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        out.append(np.unique(at[np.flatnonzero(np.diff(at, prepend=-1))]) + start)
    return np.unique(np.concatenate(out))


class SuffixIndex:
    """The family of levels. ``add`` indexes a batch and returns the heads that the batch shares with others or repeats.

    A batch is a DataFrame (head binary, doc binary, pos long); levels are Parquet tables in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []  # (batches in it, table, path), largest first

    def add(self, batch: DataFrame) -> DataFrame:
        own, path = written(self._ordered(batch), "suffixes")
        heads = own.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
        found = heads.where("n > 1").select("head")
        for _, level, _ in self.levels:  # merge scan: both sides in the order of heads
            found = found.unionByName(heads.select("head").hint("merge").join(level.select("head").distinct(), "head"))
        found, _ = written(found.distinct(), "shared")
        rank = 1
        while self.levels and self.levels[-1][0] == rank:  # equal sizes merge, as binary digits carry
            _, level, old = self.levels.pop()
            merged, new = written(self._ordered(own.unionByName(level)), "suffixes")
            remove(self.spark, path, old)
            own, path, rank = merged, new, 2 * rank
        self.levels.append((rank, own, path))
        return found

    @staticmethod
    def _ordered(suffixes: DataFrame) -> DataFrame:
        """All suffixes in the order of heads, over partitions too; one head that very many have is spread over several."""
        return suffixes.repartitionByRange(parts(suffixes), "head", "doc").sortWithinPartitions("head", "doc")

    def suffixes(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level, _ in self.levels[1:]:
            out = out.unionByName(level)
        return out


def _prefixes(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix of bytes (filled up with zeros), and their lengths."""
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in rows]), dtype=np.uint8).reshape(len(rows), width), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))


def _common(text: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common beginning of rows a and b, pair by pair."""
    out = np.minimum(size[a], size[b])
    for c in range(0, len(a), 4_096):
        differ = text[a[c : c + 4_096]] != text[b[c : c + 4_096]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
        out[c : c + 4_096] = np.minimum(out[c : c + 4_096], first)
    return out


def _covered(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """(doc, start, end): for suffixes of whole head groups, the bytes of each in a length-byte string that another one has too.

    Rows come in the order of (head, right, left): a suffix array over all compared bytes. Neighbours' common bytes
    to the right, and to the left in the order of what lies before, tell for any two depths which suffixes agree
    so far; bytes are compared, not hashes. Suffixes with the same bytes on both sides are one.
    """
    lefts, rights = rows["left"].tolist(), rows["right"].tolist()
    right, size_r = _prefixes(rights, length)
    left, size_l = _prefixes([x[::-1] for x in lefts], length - KEY)
    heads = rows["head"].to_numpy()
    n = len(rows)
    new = np.append(True, heads[1:] != heads[:-1])
    before, here = np.arange(n - 1), np.arange(1, n)
    lcp_r = np.append(-1, _common(right, size_r, before, here))
    lcp_l = np.append(-1, _common(left, size_l, before, here))
    copy = ~new & (lcp_r == size_r) & (lcp_l == size_l)
    copy[1:] &= (size_r[1:] == size_r[:-1]) & (size_l[1:] == size_l[:-1])
    one = np.flatnonzero(~copy)
    of = np.cumsum(~copy) - 1  # the representative of each row
    times = np.bincount(of)
    most, least = np.full(len(one), -1), np.full(len(one), length)  # bytes to the left at which a repeated string may start
    lo, hi = np.maximum(0, length - size_r[one]), np.minimum(length - KEY, size_l[one])
    full = (times > 1) & (lo <= hi)
    most[full], least[full] = hi[full], lo[full]
    group = np.cumsum(new[one]) - 1
    many = np.bincount(group)
    # pairs: their common bytes say it all
    a = np.flatnonzero((many[group] == 2) & new[one])
    if len(a):
        r, l = (_common(t, z, one[a], one[a + 1]) for t, z in ((right, size_r), (left, size_l)))  # noqa: E741
        for x in (a, a + 1):
            on = l + r >= length
            most[x] = np.where(on, np.maximum(most[x], l), most[x])
            least[x] = np.where(on, np.minimum(least[x], length - r), least[x])
    at = np.flatnonzero(many[group] > 2)
    if len(at):
        _groups(one[at], group[at], at, right, size_r, left, size_l, length, most, least)
    found = most[of] >= least[of]
    pos = rows["pos"].to_numpy()
    return pd.DataFrame({"doc": rows["doc"].to_numpy(), "start": pos - most[of], "end": pos - least[of] + length})[found]


def _groups(row, group, at, right, size_r, left, size_l, length, most, least) -> None:
    """Widens most and least of the suffixes of groups of three and more; row are their places in the matrices, in suffix order."""
    n = len(row)
    new = np.append(True, group[1:] != group[:-1])
    lcp_r = np.append(-1, _common(right, size_r, row[:-1], row[1:]))
    lcp_r[new] = -1
    key = left[row]
    names = [int(g).to_bytes(5, "big") + k[:z].tobytes() for g, k, z in zip(group, key, size_l[row])]
    order = np.array(sorted(range(n), key=names.__getitem__))
    lcp_l = np.append(-1, _common(left, size_l, row[order[:-1]], row[order[1:]]))
    lcp_l[np.append(True, group[order[1:]] != group[order[:-1]])] = -1
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    reach = length - KEY
    wide = max(1, min(64, (1 << 22) // n))
    alone = -1 - np.arange(n)[:, None]
    for c in range(0, reach + 1, wide):
        o = np.arange(c, min(c + wide, reach + 1))  # bytes to the left
        there = (o <= size_l[row][:, None]) & (length - o <= size_r[row][:, None])
        if not there.any():
            continue
        same_l = np.cumsum(lcp_l[:, None] < o, axis=0)[rank]
        same_r = np.cumsum(lcp_r[:, None] < length - o, axis=0)
        string = np.where(there, same_l * (n + 1) + same_r, alone)  # a name for the string at that place
        by = np.argsort(string, axis=0)
        sorted_ = np.take_along_axis(string, by, axis=0)
        twin = sorted_[1:] == sorted_[:-1]
        met = np.zeros((n, len(o)), dtype=bool)
        met[1:] = twin
        met[:-1] |= twin
        many = np.zeros_like(met)
        np.put_along_axis(many, by, met, axis=0)
        hit = np.flatnonzero(many.any(axis=1))
        first, last = c + many[hit].argmax(axis=1), c + len(o) - 1 - many[hit][:, ::-1].argmax(axis=1)
        most[at[hit]], least[at[hit]] = np.maximum(most[at[hit]], last), np.minimum(least[at[hit]], first)


def _compare(length: int, together: int = 2_000):
    """Over rows in the order of (head, right, left): compares whole groups, many small ones together."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in it:
            spans = b["head"].isna().to_numpy()
            if spans.any():
                yield pd.DataFrame({"doc": b["doc"][spans], "start": b["pos"][spans], "end": b["until"][spans].astype("int64")})
                b = b[~spans]
            if not len(b):
                continue
            if held and sum(map(len, held)) >= together:
                # all groups but the one that the new batch may go on with
                now = pd.concat(held, ignore_index=True)
                open_ = (now["head"] == now["head"].iloc[-1]).to_numpy()
                if not open_.all():
                    yield _covered(now[~open_].reset_index(drop=True), length)
                    held = [now[open_]]
            held.append(b)
        if held:
            yield _covered(pd.concat(held, ignore_index=True), length)
        release()

    return run


def repeated_spans(docs: DataFrame, length: int = 400, batches: int = 4, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): from distinct texts (doc binary, data binary), (doc, start, end) of bytes in repeated strings.

    A string is repeated if it starts anywhere else, in the same text or another. Spans may overlap. texts are
    the texts that share a head with another place, as far as their data is needed again.
    """
    spark = docs.sparkSession
    if length < KEY + 1:
        raise ValueError(f"length must be over {KEY}")

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            heads, ids, places = [], [], []
            for d, x in zip(b["doc"], b["data"]):
                at = anchors(x, length).tolist()
                heads += [x[p : p + KEY] for p in at]
                ids += [d] * len(at)
                places += at
            yield pd.DataFrame({"head": heads, "doc": ids, "pos": pd.Series(places, dtype="int64")})
            release()

    long_ones = docs.where(F.length("data") >= length)
    array, path = written(long_ones.mapInPandas(scan, "head binary, doc binary, pos long"), "anchors")
    index, shared = SuffixIndex(spark), None
    for k in range(batches):
        found = index.add(array.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k))
        shared = found if shared is None else shared.unionByName(found)
    remove(spark, path)
    heads, _ = written(shared.distinct(), "heads")
    alike, _ = written(index.suffixes().join(heads, "head", "left_semi"), "alike")
    remove(spark, *(p for _, _, p in index.levels))

    # the texts round the places, fetched once
    per_text = alike.groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    few = per_text.count() <= 1_000_000
    ids = per_text.select("doc")
    narrowed = long_ones.join(F.broadcast(ids), "doc", "left_semi") if few else long_ones
    texts, _ = written(narrowed.join(per_text.hint("merge"), "doc"), "texts")
    reach = length - KEY

    def context(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for d, x, at in zip(b["doc"], b["data"], b["places"]):
                first: dict[bytes, int] = {}
                twins: set[int] = set()
                for p in at.tolist():
                    lo, hi = max(0, p - reach), min(p + length, len(x))
                    seen = first.setdefault(b"%d:%b" % (p - lo, x[lo:hi]), p)
                    if seen == p:
                        rows.append((x[p : p + KEY], d, p, x[lo:p], x[p:hi], None))
                    elif hi - lo >= length:  # the same bytes all round: both are covered as far as one sees
                        twins |= {p, seen}
                end = -1
                for p in sorted(twins):
                    lo, hi = max(0, p - reach), min(p + length, len(x))
                    if lo <= end:
                        rows[-1] = (*rows[-1][:5], hi)
                    else:
                        rows.append((None, d, lo, None, None, hi))
                    end = hi
            yield pd.DataFrame(rows, columns=["head", "doc", "pos", "left", "right", "until"]).astype({"until": "Int64"})
            release()

    round_them = texts.mapInPandas(context, "head binary, doc binary, pos long, left binary, right binary, until long")
    sizes = alike.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    large, _ = written(sizes.where(F.col("size") > group).select("head"), "large")
    rows = round_them
    spans = None
    if large.count():
        # a group too large for a task: its strings are counted one by one, spread by their hash
        def strings(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                for a in range(0, len(b), 256):
                    out = []
                    for d, p, left, right in zip(*(b[c].iloc[a : a + 256] for c in ("doc", "pos", "left", "right"))):
                        text = np.frombuffer(left + right, dtype=np.uint8)
                        h, g = _rolling(text, length), _rolling(text[::-1], length)[::-1]
                        out.append(pd.DataFrame({"doc": [d] * len(h), "at": p - len(left) + np.arange(len(h)), "h": h.view(np.int64), "g": g.copy().view(np.int64)}))
                    yield pd.concat(out, ignore_index=True)

        big = rows.join(large, "head", "left_semi").mapInPandas(strings, "doc binary, at long, h long, g long").distinct()
        many = big.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
        spans = big.join(many, ["h", "g"], "left_semi").select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
        rows = rows.join(large, "head", "left_anti")
    rows = rows.repartition(parts(docs), F.coalesce("head", "doc")).sortWithinPartitions("head", "right", "left")
    small = rows.mapInPandas(_compare(length), "doc binary, start long, end long")
    spans = small if spans is None else spans.unionByName(small)
    return spans, texts.drop("places")


def keep(data: bytes, starts, ends) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    if not len(starts):
        return data, 0, 0
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    first, last = s[new], np.append(e[:-1][new[1:]], e[-1])
    out, at = [], 0
    for a, b in zip(first.tolist(), last.tolist()):
        out.append(data[at:a])
        at = b
    return b"".join(out) + data[at:], int((last - first).sum()), len(first)


def changed_texts(docs: DataFrame, length: int, text: str, batches: int, group: int) -> DataFrame:
    """(sha, n_removed, n_spans, kept_sha256, kept, clean) of each distinct text that loses bytes; sha is the text's sha256.

    kept are the bytes that are left, clean is their text without what a cut has left of a character.
    """
    data = in_batches(docs).select(F.col(text).cast("binary").alias("data")).where(F.length("data") >= length).withColumn("sha", F.sha2("data", 256))
    name = F.unhex(F.substring("sha", 1, 32)).alias("doc")  # half the hash names a text
    groups, _ = written(data.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.length("data")).cast("long").alias("n_bytes")), "groups")
    copies = groups.where("n > 1").select("sha")
    few = copies.count() <= 500_000
    # texts with copies give one row each to the index; all others pass without a shuffle
    single = data.join(F.broadcast(copies) if few else copies, "sha", "left_anti").select(name, "data")
    many = data.join(F.broadcast(copies) if few else copies, "sha", "left_semi").select("sha", "data")
    first = many.mapInPandas(_first_of_each, "sha string, data binary").dropDuplicates(["sha"]).select(name, "data")
    spans, texts = repeated_spans(single.unionByName(first), length, batches, group)
    per_text = spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for d, x, s, e in zip(b["doc"], b["data"], b["starts"], b["ends"]):
                left, n, k = keep(x, s, e)
                out.append((d, n, k, hashlib.sha256(left).hexdigest(), left, left.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["doc", "n_removed", "n_spans", "kept_sha256", "kept", "clean"])
            release()

    done = texts.join(per_text, "doc").mapInPandas(cut, "doc binary, n_removed long, n_spans long, kept_sha256 string, kept binary, clean string")
    whole = groups.where("n > 1").select("sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"), F.lit("").alias("clean"))
    part = groups.where("n = 1").select("sha", name).join(done, "doc").select(*whole.columns)
    return written(whole.unionByName(part), "changed")[0]


def _first_of_each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops a task's further copies before they are shuffled."""
    seen: set[str] = set()
    for b in it:
        new = ~(b["sha"].isin(seen) | b["sha"].duplicated())
        seen.update(b["sha"])
        yield b[new]


def suffix_dedup(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", batches: int = 4, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, text) of every row.

    Every byte in a length-byte string that also starts elsewhere goes, all occurrences alike, as judged on the
    input; matches never cross rows. kept is what is left (UTF-8 bytes) where something was removed, null
    elsewhere; text is the text that is left in every row, without what a cut leaves of a character. Rows with
    equal texts of at least ``length`` bytes lose everything; only one of them is indexed, so copies cost nothing.
    Null texts count as empty and stay null in text, repeated and null keys keep their rows, other columns are
    ignored, empty tables give empty results.
    """
    changed = changed_texts(docs, length, text, batches, group)
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key).alias("doc_id"), F.length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"), F.col(text).cast("string").alias("text"))
    ids = _ids(changed.select("sha"))
    none = F.lit(0).cast("long")
    same = rows.join(ids, "sha", "left_anti").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"), "text")
    other = rows.drop("text").join(ids, "sha", "left_semi").join(changed.withColumnRenamed("clean", "text").hint("merge"), "sha")
    return same.unionByName(other.select(*same.columns))


def _ids(ids: DataFrame) -> DataFrame:
    """Names of changed texts, broadcast if they are few: rows that keep their text then pass without a shuffle."""
    return F.broadcast(ids) if ids.count() <= 500_000 else ids


def deduplicated(docs: DataFrame, length: int = 400, text: str = "text", batches: int = 4, group: int = GROUP) -> DataFrame:
    """docs with repeated strings cut out of their texts; every row and column stays, a text may become empty.

    What a cut leaves of a character at a span's edge is dropped, so texts stay valid UTF-8. A column n_chars,
    if there is one, counts again. Null texts stay null, repeated rows are cut alike (each repeats the other),
    other columns pass whatever their names, an empty table gives an empty result.
    """
    sha, kept = fresh(docs, "sha"), fresh(docs, "kept")
    changed = changed_texts(docs, length, text, batches, group)
    changed = changed.select(F.col("sha").alias(sha), F.col("clean").alias(kept))
    named = docs.withColumn(sha, F.sha2(F.col(text).cast("binary"), 256))
    ids = _ids(changed.select(sha))
    same = named.join(ids, sha, "left_anti").select(*docs.columns)
    other = named.drop(text).join(ids, sha, "left_semi").join(changed.hint("merge"), sha).withColumnRenamed(kept, text)
    if "n_chars" in docs.columns:
        other = other.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return same.unionByName(other.select(*docs.columns))
