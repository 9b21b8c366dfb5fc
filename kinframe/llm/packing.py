"""Packing token pieces into sequences by bin completion.

What decides a packing is only how many pieces of each length there are: at most ``capacity`` numbers, however many
documents. One task finds the fillings over this table, each with the number of sequences that take it; the pieces
are numbered within their length by range-partitioned prefix sums, and a piece's number tells its sequence and place.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, in_batches, prefix_sums, release, remove, written
from .token_store import _runs, encoder

#: Fillings that branch-and-bound tries before the best packing so far stands, steps of one enumeration, fillings it returns.
TRIES, STEPS, WIDTH = 10_000, 500, 24

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: for each threshold, long pieces stand alone and the middle ones fill what they leave."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = [counts[x] for x in lengths.tolist()]
    if not n:
        return 0
    many = np.array([0, *np.cumsum(np.array(n, dtype=object))], dtype=object)
    total = np.array([0, *np.cumsum(np.array([x * c for x, c in zip(lengths.tolist(), n)], dtype=object))], dtype=object)
    at = lambda x: int(np.searchsorted(lengths, x, side="right"))  # noqa: E731  # lengths up to x
    best = -(-total[-1] // capacity)
    half = at(capacity // 2)
    for k in [0, *[x for x in lengths.tolist() if 2 * x <= capacity]]:
        long = at(capacity - k)
        alone, middle = many[-1] - many[long], many[long] - many[half]
        rest = total[half] - total[at(k - 1) if k else 0]
        room = middle * capacity - (total[long] - total[half])
        best = max(best, alone + middle + max(0, -(-(rest - room) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the table: pieces of a length go together to the fullest sequences that take them."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room: fillings and how many sequences have them
    rooms: list[int] = []
    done: list[tuple[dict[int, int], int]] = []

    def put(room: int, filling: dict[int, int], n: int) -> None:
        if not room:
            done.append((filling, n))
            return
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((filling, n))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                each = capacity // x
                n = left // each
                if n:
                    put(capacity - each * x, {x: each}, n)
                    left -= n * each
                if left:
                    put(capacity - left * x, {x: left}, 1)
                    left = 0
                break
            room = rooms[i]
            filling, n = open_[room].pop()
            each = min(room // x, left)
            use = min(n, left // each)
            if use < n:
                open_[room].append((filling, n - use))
            if not open_[room]:
                del open_[room], rooms[i]
            put(room - each * x, {**filling, x: filling.get(x, 0) + each}, use)
            left -= each * use
    for some in open_.values():
        done += some
    return [(tuple(sorted(f.items(), reverse=True)), n) for f, n in done]


def _dominated(filling: list[tuple[int, int]], slack: int, free: int) -> bool:
    """Whether a free piece (a bit of ``free`` for each length) fits as well, or could stand for some pieces of the filling."""
    one = several = 0
    sums = 1  # bit t: some pieces add up to t
    for x, c in filling:
        for _ in range(c):
            more = sums << x
            several |= (sums & ~1) << x
            one |= 1 << x
            if sums | more == sums:
                break
            sums |= more
    if free & ((1 << slack + 1) - 2) or several & free:
        return True
    return any((one | several) << d & free for d in range(1, slack + 1))


def fillings(counts: dict[int, int], lengths: list[int], first: int, capacity: int, waste: int) -> list[tuple[int, Filling]]:
    """(waste, filling) around a piece of length ``first``, least waste first: undominated ones that waste no more than allowed.

    lengths are those with pieces left, ascending. Longer pieces are tried first; the search takes STEPS steps and
    returns WIDTH fillings at the most.
    """
    found: list[tuple[int, Filling]] = []
    steps = 0
    chosen: list[tuple[int, int]] = []
    sums = [0, *accumulate(x * counts[x] for x in lengths)]  # of the pieces up to each length
    free = 0
    for x in lengths:
        free |= 1 << x
    if counts[first] == 1:
        free &= ~(1 << first)

    def note(room: int) -> None:
        unused = free
        for x, c in chosen:
            if counts[x] - (x == first) == c:
                unused &= ~(1 << x)
        if room <= waste and not _dominated(chosen, room, unused):
            every = dict(chosen)
            every[first] = every.get(first, 0) + 1
            found.append((room, tuple(sorted(every.items(), reverse=True))))

    def go(i: int, room: int) -> None:
        """Adds pieces of lengths before the i-th."""
        nonlocal steps
        i = min(i, bisect_right(lengths, room))
        if not i or not room:
            note(room)
            return
        while i and steps < STEPS and len(found) < WIDTH and room - sums[i] <= waste:
            i -= 1
            x = lengths[i]
            for c in range(min(counts[x] - (x == first), room // x), 0, -1):
                steps += 1
                chosen.append((x, c))
                go(i, room - c * x)
                chosen.pop()
                if steps >= STEPS or len(found) >= WIDTH:
                    return
        if not i and room <= waste:
            note(room)

    go(len(lengths), capacity - first)
    return sorted(found, key=lambda f: (f[0], [-x for x, _ in f[1]]))


def completed(counts: dict[int, int], capacity: int, tries: int = TRIES) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences take each, for pieces of at most ``capacity``: as few sequences as the search finds.

    Branch-and-bound: the longest piece left is completed by each undominated filling in turn, taken as often as the
    pieces allow and then once; a branch ends when the waste so far, or the bound on what is left, can't beat the
    incumbent, which best-fit gives first. It ends at the lower bound, or after ``tries`` fillings.
    """
    counts = {int(x): int(c) for x, c in counts.items() if c}
    whole = [(((capacity, 1),), counts.pop(capacity))] if capacity in counts else []
    if not counts:
        return whole
    best = best_fit(counts, capacity)
    fewest, least, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(x * c for x, c in counts.items())
    lengths = sorted(counts)
    taken: list[tuple[Filling, int]] = []
    waste = used = done = 0
    stack: list[list] = []  # options of each level: (filling, waste, times) still to try

    def options() -> list:
        first = lengths[-1]
        allowed = (fewest - 1) * capacity - total - waste
        out = []
        for w, f in fillings(counts, lengths, first, capacity, allowed):
            times = min(counts[x] // c for x, c in f)
            out += [(f, w, t) for t in dict.fromkeys((times, 1)) if w * t <= allowed]
        return out[::-1]

    def change(f: Filling, times: int) -> None:
        for x, c in f:
            was = counts[x]
            counts[x] = was - c * times
            if was and not counts[x]:
                lengths.pop(bisect_left(lengths, x))
            elif not was and counts[x]:
                lengths.insert(bisect_left(lengths, x), x)

    if fewest > least:
        stack.append(options())
    while stack and done < tries and fewest > least:
        if len(taken) == len(stack):  # back from below: undo this level's choice
            f, times = taken.pop()
            change(f, -times)
            used -= times
            waste -= times * (capacity - sum(x * c for x, c in f))
        if not stack[-1]:
            stack.pop()
            continue
        f, w, times = stack[-1].pop()
        if waste + w * times > (fewest - 1) * capacity - total:
            continue
        done += 1
        change(f, times)
        taken.append((f, times))
        used += times
        waste += w * times
        if not lengths:
            if used < fewest:
                best, fewest = list(taken), used
            continue
        # the dearer bound only where the tree is small
        if len(lengths) <= 64 and used + lower_bound({x: counts[x] for x in lengths}, capacity) >= fewest:
            continue
        stack.append(options())
    return whole + best


def token_pieces(docs: DataFrame, vocabulary: str, most: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): every whole text's ids and end_id, cut after each ``most`` ids.

    ids are little-endian unsigned 32-bit integers; start counts the document's ids before the piece. Null texts are
    empty (the end id alone), null keys and repeated rows keep their rows, other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, 4), np.array([end_id], dtype="<u4")
        for b in batches:
            keys, texts = b.column(0), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for first, last in _runs(texts, 2_000_000):
                row, piece, start, length, ids = [], [], [], [], []
                for i, found in enumerate(enc.all_of(texts[first:last]), first):
                    found = np.append(found, end)
                    for k, at in enumerate(range(0, len(found), most)):
                        cut = found[at : at + most]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        ids.append(cut.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
            release()

    rows = in_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _slots(capacity: int):
    """From the one table of (length, n): for each length the slots of its pieces, in the order in which they are numbered."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for b in batches:
            counts.update(zip(b["length"].tolist(), b["n"].tolist()))
        out, sequence, used = [], 0, dict.fromkeys(counts, 0)
        for filling, n in completed(counts, capacity):
            at = 0
            for x, c in filling:
                out.append((x, used[x], c, sequence, at))
                used[x] += c * n
                at += c * x
            sequence += n
        yield pd.DataFrame(out, columns=["length", "first", "each", "sequence", "at"]).astype("int64")

    return solve


def packed(pieces: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: as few sequences of at most ``capacity`` as the search finds; no piece is cut.

    offset is where the piece begins in its sequence; a sequence's pieces follow one another without gaps from 0.
    All other columns are kept. Lengths must be from 1 to capacity (else an error); an empty table gives an empty
    result; repeated rows are pieces of their own. ``order`` should tell rows apart; rows that it doesn't take their
    places in any order. The table of lengths has ``capacity`` rows at the most and goes to one task; the fillings
    that come back are bounded by it too.
    """
    spark = pieces.sparkSession
    rows, at_rows = written(pieces, "pieces")
    hist = rows.groupBy(F.col(length).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    hist, at_hist = written(hist, "lengths")
    if hist.where(f"length is null or length < 1 or length > {int(capacity)}").count():
        raise ValueError(f"pieces must have lengths from 1 to {capacity}")
    slots = hist.coalesce(1).mapInPandas(_slots(capacity), "length long, first long, each long, sequence long, at long").toPandas()
    slots = slots.sort_values(["length", "first"], kind="stable")
    sizes = dict(sorted((r["length"], r["n"]) for r in hist.collect()))  # capacity rows at the most
    before, base = 0, {}
    for x, n in sizes.items():
        base[x], before = before, before + n
    # a piece's number in the order of lengths finds its entry by one search
    table = slots.assign(first=slots["first"] + slots["length"].map(base)) if len(slots) else slots
    entries = {c: table[c].to_numpy(dtype="int64") for c in table.columns}
    place, seq, off = fresh(rows, "_place"), "sequence_id", "offset"
    numbered = prefix_sums(rows, [length, *order], {place: F.lit(1)}, "places").drop(f"_total_{place}")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column(b.num_columns - 1).to_numpy()
            e = np.searchsorted(entries["first"], r, side="right") - 1
            k = r - entries["first"][e]
            each = entries["each"][e]
            new = [pa.array(entries["sequence"][e] + k // each), pa.array(entries["at"][e] + k % each * entries["length"][e])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], seq, off])

    from pyspark.sql.types import LongType, StructType

    kept = [c for c in rows.columns if c.lower() not in (seq, off)]
    kind = StructType([rows.schema[c] for c in kept]).add(seq, LongType()).add(off, LongType())
    out = numbered.select(*kept, place).mapInArrow(assign, kind)
    remove(spark, at_hist, at_rows)  # places are written
    return out


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids): the joined ids of each sequence that packed() made (one sequence is bounded by its capacity)."""
    parts_ = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    joined = F.aggregate(parts_, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
