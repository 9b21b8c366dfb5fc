"""Periodic runs of words: aligned blocks, found again at a distance of their own scale, seed exact extension.

A run is a stretch with smallest period q and at least max(24, 3 q) words that no neighbouring word extends. Let s be
the power of two with s <= q < 2 s, or 8 for shorter periods. The run's words that come again q words later number at
least 2 q (16 for short periods), so they hold a whole block of s words that starts at a multiple of s. An
Aho-Corasick automaton of such blocks runs over the document's word numbers; each place where a block comes again at
a distance from s to 2 s - 1 (1 to 15 for the scale 8) is a seed, which is extended to both sides by comparing words.
Every run has a seed, whatever the period, and every stretch is verified word by word.

A key is eight numbers at every scale: stretches of s / 8 words are numbered exactly, by doubling (pairs of numbers),
not by a hash. Only blocks that can come again go into an automaton: every stretch of eight words inside them must come
again within 2 s words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, release

#: The smallest block, and the words and periods that a run has at least.
BLOCK, LEAST_WORDS, LEAST_PERIODS = 8, 24, 3
#: Blocks that an automaton holds, so that its size is bounded by the scale and its root has few children.
TOGETHER = 256


def _numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def _next(names: np.ndarray) -> np.ndarray:
    """How far from each place its name comes again (never: a distance beyond the end)."""
    order = np.argsort(names, kind="stable")
    again = np.full(len(names), np.iinfo(np.int64).max)
    same = names[order[1:]] == names[order[:-1]]
    again[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return again


def _doubled(names: np.ndarray, k: int) -> np.ndarray:
    """Names of k words from each place on to names of 2 k words; equal stretches have equal names."""
    return np.unique(names[:-k] * np.int64(len(names) + k + 1) + names[k:], return_inverse=True)[1]


def _seeds(names: np.ndarray, starts: np.ndarray, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) at which the blocks of s words at ``starts`` come again at the scale's distances.

    ``names`` are those of s / BLOCK words from each place on, so that a key has BLOCK of them at every scale, and
    the document is searched once for each remainder of places.
    """
    import ahocorasick

    least, step = 1 if s == BLOCK else s, s // BLOCK
    for g in np.split(starts, np.flatnonzero(np.diff(starts // (TOGETHER * s))) + 1):
        first = int(g[0])
        part = names[first : int(g[-1]) + 3 * s]
        keys = part[(g - first)[:, None] + np.arange(0, s, step)]
        none = int(part.max()) + 1  # stands between the searches
        rows = -(-len(part) // step) + 1
        lines = np.full(rows * step, none, dtype=np.int64)
        lines[: len(part)] = part
        lines = lines.reshape(rows, step).T.ravel()
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        content = np.empty(len(g), dtype=np.int64)
        for i, key in enumerate(map(tuple, keys.tolist())):
            content[i] = found.get(key, i)  # an equal block that came before keeps its number
            found.add_word(key, int(content[i]))
        found.make_automaton()
        hits = np.array(list(found.iter(tuple(lines.tolist()))), dtype=np.int64).reshape(-1, 2)
        place = (hits[:, 0] % rows - (BLOCK - 1)) * step + hits[:, 0] // rows
        width = np.int64(len(part) + 4 * s)
        at = np.sort(hits[:, 1] * width + place)
        own = content * width + (g - first)
        lo, hi = np.searchsorted(at, own + least), np.searchsorted(at, own + 2 * s - 1, side="right")
        many = hi - lo
        of = np.repeat(np.arange(len(g)), many)
        nth = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        yield g[of], at[nth] - own[of]


def _equal(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j > i on are equal, forwards (step 1) or backwards from them (step -1)."""
    n, size = 0, 64
    room = len(w) - j if step > 0 else i
    while n < room:
        m = min(size, room - n)
        if step > 0:
            differ = w[i + n : i + n + m] != w[j + n : j + n + m]
        else:
            differ = w[i - n - m : i - n][::-1] != w[j - n - m : j - n][::-1]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, size = n + m, min(2 * size, 1 << 20)
    return n


def _inside(runs: list[tuple[int, int, int]], p: np.ndarray, q: np.ndarray, s: int) -> np.ndarray:
    """Which seeds (in the order of p) lie in a run whose period divides theirs: they would only find it again."""
    known = np.zeros(len(p), dtype=bool)
    for start, length, period in runs:
        a, b = np.searchsorted(p, (start, start + length - s))
        if a < b:
            known[a:b] |= (p[a:b] + q[a:b] + s <= start + length) & (q[a:b] % period == 0)
    return known


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers w, by start, then period."""
    n = len(w)
    if n < LEAST_WORDS:
        return []
    names = w
    for k in (1, 2, 4):
        names = _doubled(names, k)
    again = _next(names)
    found: dict[tuple[int, int], int] = {}
    names, k, s = w, 1, BLOCK
    while LEAST_PERIODS * (s if s > BLOCK else 1) <= n:
        starts = np.arange(0, n - s + 1, s)
        late = np.concatenate(([0], np.cumsum(again >= 2 * s)))
        starts = starts[late[np.minimum(starts + s - BLOCK + 1, len(again))] == late[starts]]
        while len(starts) and k < s // BLOCK:
            names, k = _doubled(names, k), 2 * k
        shorter = sorted((a, m, q) for (a, m), q in found.items())
        until: dict[int, int] = {}  # by period: where its last stretch's repeated part ends
        for p, q in _seeds(names, starts, s) if len(starts) else ():
            by = np.argsort(p, kind="stable")
            p, q = p[by], q[by]
            new = ~_inside(shorter, p, q, s)
            for i, d in zip(p[new].tolist(), q[new].tolist()):
                if i < until.get(d, 0):
                    continue
                left, right = _equal(w, i, i + d, -1), _equal(w, i, i + d, 1)
                until[d] = i + right
                length = left + right + d
                if length >= max(LEAST_WORDS, LEAST_PERIODS * d):
                    at = (i - left, length)
                    found[at] = min(d, found.get(at, d))
        s *= 2
    return sorted(((a, m, q) for (a, m), q in found.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """The place in the list of the run with the greatest length / period, compared exactly; of equals the first."""
    best = None
    for k, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) of every row, from its whole text.

    Words are what space and \\t to \\r separate. runs has (start, length, period) of every run, by start, then
    period; strongest is the place in it (from 0) of the run with the greatest length / period, null without
    runs; collapsed is the text of the words that are left when each run keeps its first period. ``rewrite`` may
    replace the words of a row, given its key and its words, before all else.

    Null and empty texts have no words and no runs, and collapse to an empty text; null keys and repeated rows
    keep their rows; other columns are ignored; an empty table gives an empty result. Rows are independent, so
    nothing is shuffled; a text takes memory in proportion to its own length.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest int, collapsed string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, best, left, ends = [], [], [], [], [0]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = (t or b"").split()
                if rewrite is not None:
                    words = rewrite(k, words)
                found = runs_of(_numbers(words))
                n.append(len(words))
                runs += found
                ends.append(len(runs))
                best.append(strongest(found))
                left.append(collapsed(words, found))
            flat = np.array(runs, dtype=np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), lists, pa.array(best, pa.int32()), pa.array(left, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )
            release()

    return in_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, out)


def with_planted_period(key: object, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail for each tenth key, as its CRC-32 says; null keys have none."""
    import zlib

    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """A row a document of what periodic_runs() found: the strongest run, and SHA-256 of all runs and of the collapsed text."""
    best = F.get("runs", F.col("strongest"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    length, period = best["length"], best["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * runs[strongest].length) div runs[strongest].period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
