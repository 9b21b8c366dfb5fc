"""SentencePiece segmentations by Gumbel top-k without replacement: a perturbed A* search over the lattice.

A text (its spaces as U+2581, one put in front) is cut between any two characters that stand side by side in no
piece; each distinct stretch has a lattice of the vocabulary's pieces (byte pieces for characters without one). The
vocabulary is of kind BPE and has ranks, not probabilities, so a piece of rank r weighs (r + 2)^-temperature and
a segmentation the product of its pieces; backward sums make that a chain of conditional choices.

Search: a region is the set of segmentations that share a path up to a choice and avoid some edges there. The
largest Gumbel-perturbed log-probability of a region is a Gumbel at the log of its mass, truncated at its
parent's. The whole space is the first region; the region with the highest bound is popped, its best
segmentation is drawn, and what is left of it falls into one region for each later choice (one less edge there).
Bounds are exact, so segmentations come in the order of their perturbed log-probabilities: a sample without
replacement. The bound that would be popped next is the threshold for inclusion scores. All randomness is a hash
of (seed, row key, sample, place), so results don't depend on batches or partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BASE, Table, mix
from .shared import in_batches, release

SPACE = "▁"
_ALL = (1 << 64) - 1
#: Lattice nodes that a worker keeps between batches, and characters of texts that are sampled together.
REMEMBERED, TOGETHER = 300_000, 200_000


class Lattices:
    """Lattices of distinct stretches in flat arrays.

    A node is a place before a character of a stretch. Its edges lie side by side from ``first`` on, shorter pieces
    before longer ones: the node that an edge comes from and goes to (-1: the stretch's end), its piece, its
    conditional log-probability given that the path has come to its node, the log of its siblings' mass, and the
    running sum of probabilities up to it. Stretches are known by a 64-bit hash; that a decoded text equals the input is checked in the end.
    """

    def __init__(self, model: str, temperature: float):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.vocab_size()
        pieces: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        first = None
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                pieces.append(bytes([int(piece[3:5], 16)]))
            elif self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                pieces.append(b"")
            else:
                first = i if first is None else first
                self.ids[piece] = i
                pieces.append(piece.replace(SPACE, " ").encode())
        self.score = {p: -temperature * log(2 + i - first) for p, i in self.ids.items()}
        self.byte_score = -temperature * log(2 + n)
        self.n_pieces, self.longest = n, max(map(len, self.ids), default=1)
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_at = np.cumsum(self.piece_sizes) - self.piece_sizes
        # scores by entry: pieces, then groups of byte pieces that stand for one character
        self.scores = np.full(n, -np.inf)
        for piece, i in self.ids.items():
            self.scores[i] = self.score[piece]
        self.groups: dict[int, int] = {}
        self.group_ids: list[list[int]] = []
        known: dict[int, int] = {}  # hashes of all beginnings of pieces: -1, or the piece's id
        for piece, i in self.ids.items():
            h = 0
            for k, c in enumerate(piece):
                h = (h * BASE + ord(c) + 1) & _ALL
                if k + 1 == len(piece):
                    known[h] = i
                else:
                    known.setdefault(h, -1)
        self.beginnings = Table(max(4, (4 * len(known)).bit_length()))
        self.beginnings.put(np.array(list(known), dtype=np.uint64), np.array(list(known.values()), dtype=np.int64))
        # characters of pieces in classes, and which classes stand side by side in a piece
        letters = sorted({c for p in self.ids for c in p})
        self.kinds = len(letters) + 1
        self.kind = np.zeros(max(map(ord, letters), default=0) + 2, dtype=np.int64)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros(self.kinds**2, dtype=bool)
        for p in self.ids:
            k = self.kind[[ord(c) for c in p]]
            self.beside[k[:-1] * self.kinds + k[1:]] = True
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.roots = Table(20)
        self.n_stretches = self.n_nodes = self.n_edges = 0
        room = 1 << 19  # memory is taken as it is written to
        self.first = np.zeros(room, dtype=np.int64)
        self.cum, self.logp, self.rest = (np.zeros(4 * room) for _ in range(3))
        self.frm, self.to, self.entry = (np.zeros(4 * room, dtype=np.int32) for _ in range(3))

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, starts of stretches, stretches of each text): texts with their space in front, cut where no piece reaches over."""
        chars = np.frombuffer("".join([SPACE + t.replace(" ", SPACE) for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        kind = self.kind[np.minimum(chars, len(self.kind) - 1)]
        new = np.ones(len(chars) + 1, dtype=bool)
        new[1:-1] = ~self.beside[kind[:-1] * self.kinds + kind[1:]]
        new[begin] = True
        starts = np.flatnonzero(new[:-1])
        return chars, starts, np.diff(np.searchsorted(starts, begin))

    def nodes_of(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first node of each stretch; new ones are built."""
        n = len(chars)
        if n > len(self.powers):
            self.powers = np.cumprod(np.full(n, BASE, dtype=np.uint64))
            self.inverses = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64))
        sizes = np.diff(np.append(starts, n))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((chars + np.uint64(1)) * self.powers[:n])))
        h = mix((sums[starts + sizes] - sums[starts]) * self.inverses[starts] + sizes.astype(np.uint64)) | np.uint64(1)
        hit, roots = self.roots.get(h)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            keys, one = np.unique(h[miss], return_index=True)
            one = miss[one]
            if 2 * (self.n_stretches + len(keys)) > len(self.roots.keys):
                old = np.flatnonzero(self.roots.keys)
                larger = Table((4 * (self.n_stretches + len(keys))).bit_length())
                larger.put(self.roots.keys[old], self.roots.values[old])
                self.roots = larger
            many = sizes[one]
            at = np.repeat(starts[one] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            self.roots.put(keys, self._build(chars[at], many))
            self.n_stretches += len(keys)
            roots[miss] = self.roots.get(h[miss])[1]
        return roots

    def _build(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first nodes of new stretches."""
        n = len(chars)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(n)  # characters to the stretch's end
        place, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        froms, sizes, entries = [], [], []
        for k in range(self.longest):
            on = left[place] > k
            place, h = place[on], h[on]
            if not len(place):
                break
            h = h * np.uint64(BASE) + chars[place + k] + np.uint64(1)
            hit, ids = self.beginnings.get(h)
            place, h, ids = place[hit], h[hit], ids[hit]
            piece = ids >= 0
            froms.append(place[piece])
            sizes.append(np.full(len(froms[-1]), k + 1))
            entries.append(ids[piece])
        alone = np.ones(n, dtype=bool)
        alone[froms[0]] = False
        if alone.any():  # characters without a piece
            which = chars[alone].tolist()
            for c in sorted(set(which) - self.groups.keys()):
                self.groups[c] = self.n_pieces + len(self.group_ids)
                self.group_ids.append([self.byte_ids[b] for b in chr(c).encode("utf-8", "replace")])
                self.scores = np.append(self.scores, self.byte_score * len(self.group_ids[-1]))
            froms.append(np.flatnonzero(alone))
            sizes.append(np.ones(len(which), dtype=np.int64))
            entries.append(np.array([self.groups[c] for c in which], dtype=np.int64))
        frm, size, entry = (np.concatenate(v) for v in (froms, sizes, entries))
        # nodes near an end first, for the backward sums
        rank = np.empty(n, dtype=np.int64)
        rank[by := np.argsort(left, kind="stable")] = np.arange(n)
        order = np.argsort(rank[frm] * (self.longest + 1) + size, kind="stable")
        frm, size, entry = frm[order], size[order], entry[order]
        many = np.bincount(rank[frm], minlength=n)  # edges of each node
        bounds = np.concatenate(([0], np.cumsum(many)))
        x, to = self.scores[entry], frm + size
        last = size == left[frm]
        beta = np.zeros(n + 1)
        goes = np.where(last, n, to)  # n: nothing is left
        p, logp = np.empty(len(x)), np.empty(len(x))
        near = np.concatenate(([0], np.cumsum(np.bincount(left)[1:]))).tolist()  # the first node of each distance
        edge = bounds[near].tolist()
        for i, j, lo, hi in zip(near[:-1], near[1:], edge[:-1], edge[1:]):
            if j > i:
                v, heads, times = x[lo:hi] + beta[goes[lo:hi]], bounds[i:j] - lo, many[i:j]
                top = np.maximum.reduceat(v, heads)
                e = np.exp(v - np.repeat(top, times))
                total = np.add.reduceat(e, heads)
                beta[by[i:j]] = own = top + np.log(total)
                p[lo:hi] = e / np.repeat(total, times)
                logp[lo:hi] = v - np.repeat(own, times)
        heads = bounds[:-1]
        cum = np.cumsum(p)
        cum -= np.repeat(cum[heads] - p[heads], many)
        cum[bounds[1:] - 1] = 2.0  # the last piece takes the rest
        big = p > 0.5  # one a node at the most: its siblings are summed, for 1 - p would lose their digits
        with np.errstate(divide="ignore"):
            others = np.log(np.add.reduceat(np.where(big, 0.0, p), heads))
        rest = np.where(big, np.repeat(others, many), np.log1p(-np.where(big, 0.0, p)))
        nodes, edges = self.n_nodes + n, self.n_edges + len(x)
        room = lambda a, need: a if need <= len(a) else np.concatenate((a, np.zeros(max(need, len(a) * 3 // 2) - len(a), dtype=a.dtype)))
        self.first = room(self.first, nodes)
        self.first[self.n_nodes + by] = self.n_edges + heads
        for name, v in (("cum", cum), ("logp", logp), ("rest", rest), ("frm", frm + self.n_nodes), ("to", np.where(last, -1, to + self.n_nodes)), ("entry", entry)):
            setattr(self, name, kept := room(getattr(self, name), edges))
            kept[self.n_edges : edges] = v
        out = ends - lengths + self.n_nodes
        self.n_nodes, self.n_edges = nodes, edges
        return out

    def row(self, edge: int, without: set[int]) -> np.ndarray:
        """An edge and its siblings, without some."""
        node = self.frm[edge]
        e = int(self.first[node])
        out = []
        while e < self.n_edges and self.frm[e] == node:
            if e not in without:
                out.append(e)
            e += 1
        return np.array(out, dtype=np.int64)

    def encoded(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of each path."""
        if not paths:
            return []
        e = self.entry[np.concatenate(paths)]
        ends = np.cumsum([len(p) for p in paths])
        at = np.flatnonzero(e >= self.n_pieces)
        if len(at):
            groups = [self.group_ids[x - self.n_pieces] for x in e[at].tolist()]
            many = np.ones(len(e), dtype=np.int64)
            many[at] = [len(g) for g in groups]
            until = np.concatenate(([0], np.cumsum(many)))
            e = np.repeat(e, many)
            e[np.repeat(until[at], many[at]) + np.concatenate([np.arange(len(g)) for g in groups])] = np.concatenate(groups)
            ends = until[ends]
        return np.split(e, ends[:-1])

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of runs of piece ids, without the space put in front."""
        if not ids:
            return []
        every = np.concatenate(ids)
        sizes = self.piece_sizes[every]
        ends = np.cumsum(sizes)
        flat = self.piece_bytes[np.repeat(self.piece_at[every] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(x) for x in ids])))].tolist()
        return [flat[i + (flat[i : i + 1] == b" " and j > i) : j] for i, j in zip(at[:-1], at[1:])]


@lru_cache(maxsize=1)
def lattices(model: str, temperature: float) -> Lattices:
    return Lattices(model, temperature)


#: What a draw is for; it is part of its counter.
_ROOT, _PATH, _TURN, _AGAIN, _REGION = range(5)


def _streams(keys: np.ndarray, sample: int, use: int) -> np.ndarray:
    """A stream of randomness for each row key, sample and use."""
    return mix(keys + np.uint64((sample * 8 + use + 1) * BASE & _ALL))


def _uniform(streams: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """In (0, 1), a hash of each stream and counter."""
    x = mix(streams + np.asarray(counter, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 4503599627370496.0


def _paths(lat: Lattices, nodes: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, counts): a random path from each node to its stretch's end, all stretches a step at a time."""
    active, state, steps, step = np.arange(len(nodes)), nodes, [], 1
    counts = np.zeros(len(nodes), dtype=np.int64)
    while len(active):
        u, e = _uniform(streams, step), lat.first[state]
        more = np.flatnonzero(lat.cum[e] <= u)
        while len(more):
            e[more] += 1
            more = more[lat.cum[e[more]] <= u[more]]
        steps.append((active, e))
        counts[active] += 1
        state = lat.to[e]
        on = np.flatnonzero(state >= 0)
        active, state, streams, step = active[on], state[on], streams[on], step + 1
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = np.zeros(int(counts.sum()), dtype=np.int64)
    for k, (a, e) in enumerate(steps):
        out[begin[a] + k] = e
    return out, counts


def _truncated(bound: float, z: float) -> float:
    """A Gumbel at a log mass, truncated at the bound; z is log(-log(u)) - mass."""
    return -float(np.logaddexp(-bound, z))


class _Row:
    """The search of one text: its heap of (bound, tie, region) and the segmentations drawn."""

    __slots__ = ("key", "heap", "leaves", "roots")

    def __init__(self, key: int, roots: np.ndarray):
        self.key, self.roots, self.heap, self.leaves = np.uint64(key), roots, [], []


def _turn(lat: Lattices, r: _Row, region, sample: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(path up to and with a new choice, nodes to go on from, stretches before them) of a region."""
    leaf, d, without = region
    old = r.leaves[leaf][0]
    left = lat.row(int(old[d]), without)
    logp = lat.logp[left]
    p = np.exp(logp - logp.max()).cumsum()
    u = float(_uniform(_streams(np.array([r.key]), sample, _TURN), d)[0])
    e = int(left[min(int(np.searchsorted(p, u * p[-1], side="right")), len(p) - 1)])
    stretch = int(np.count_nonzero(lat.to[old[:d]] < 0))  # stretches that end before the choice
    nodes, to = r.roots[stretch + 1 :], int(lat.to[e])
    if to < 0:
        stretch += 1
    else:
        nodes = np.append(to, nodes)
    return np.append(old[:d], e), nodes, stretch


def sample_texts(lat: Lattices, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log_prob, perturbed, log_inclusion), best perturbed value first."""
    if lat.n_nodes > REMEMBERED:
        lat.clear()
    chars, starts, counts = lat.cut(texts)
    roots = lat.nodes_of(chars, starts)
    first = -np.log(-np.log(_uniform(_streams(np.array(keys, dtype=np.uint64), 0, _ROOT), 0)))
    ends = np.concatenate(([0], np.cumsum(counts))).tolist()
    rows = [_Row(key, roots[i:j]) for key, i, j in zip(keys, ends[:-1], ends[1:])]
    for r, g in zip(rows, first.tolist()):
        r.heap = [(-g, 0, None)]
    for sample in range(k):
        jobs = [(r, *heapq.heappop(r.heap)) for r in rows if r.heap and len(r.leaves) == sample]
        if not jobs:
            break
        begun = [(np.empty(0, dtype=np.int64), r.roots, 0) if region is None else _turn(lat, r, region, sample) for r, _, _, region in jobs]
        row_keys = np.array([r.key for r, *_ in jobs], dtype=np.uint64)
        many = [len(nodes) for _, nodes, _ in begun]
        places = np.concatenate([np.arange(s, s + n, dtype=np.uint64) for n, (_, _, s) in zip(many, begun)])
        tails, counts = _paths(lat, np.concatenate([nodes for _, nodes, _ in begun]), mix(np.repeat(_streams(row_keys, sample, _PATH), many) + places * np.uint64(BASE)))
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(many)))].tolist()
        paths = [np.concatenate((head, tails[i:j])) for (head, _, _), i, j in zip(begun, ends[:-1], ends[1:])]
        # what all texts' places need, at once: log-probabilities, siblings' masses, and log(-log(u))
        flat, sizes = np.concatenate(paths), [len(p) for p in paths]
        logp, rest = lat.logp[flat], lat.rest[flat]
        places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        noise = np.log(-np.log(_uniform(np.repeat(_streams(row_keys, sample, _REGION), sizes), places)))
        at = 0
        for (r, neg, _, region), path, n in zip(jobs, paths, sizes):
            _open(lat, r, path, logp[at : at + n], rest[at : at + n], noise[at : at + n], -neg, region, sample, k)
            at += n
    ids = iter(lat.encoded([path for r in rows for path, _, _ in r.leaves]))
    out = []
    for r in rows:
        kappa, got = -r.heap[0][0] if r.heap else -np.inf, []
        for _, lp, g in r.leaves:
            x = lp - kappa  # inclusion: 1 - exp(-exp(x))
            got.append((next(ids), lp, g, 0.0 if x > 4 else (x if x < -30 else log(-np.expm1(-exp(x))))))
        out.append(got)
    return out


def _open(lat: Lattices, r: _Row, path, logp, rest, noise, bound: float, region, sample: int, k: int) -> None:
    """Records a popped segmentation and pushes the regions that are left, the best k + 1 of them: no more can be popped."""
    before = np.concatenate(([0.0], np.cumsum(logp)))
    r.leaves.append((path, float(before[-1]), bound))
    leaf, d0 = len(r.leaves) - 1, 0
    if region is not None:
        d0 = region[1]
        without = region[2] | {int(path[d0])}
        if len(left := lat.row(int(path[d0]), without)):
            mass = float(before[d0] + np.logaddexp.reduce(lat.logp[left]))
            u = float(_uniform(_streams(np.array([r.key]), sample, _AGAIN), d0)[0])
            heapq.heappush(r.heap, (-_truncated(bound, log(-log(u)) - mass), sample * (1 << 40) + d0, (leaf, d0, without)))
        d0 += 1
    z = noise[d0:] - before[d0:-1] - rest[d0:]  # the least is the highest bound
    best = np.argpartition(z, k)[: k + 1] if len(z) > k + 1 else np.arange(len(z))
    for x in best.tolist():
        if rest[d0 + x] > -np.inf:
            d = d0 + x
            heapq.heappush(r.heap, (-_truncated(bound, float(z[x])), sample * (1 << 40) + d, (leaf, d, {int(path[d])})))


_OUT = "sample int, n_pieces int, ids binary, log_prob double, perturbed double, log_inclusion double, decoded boolean"


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, temperature: float = 1.0, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sample, n_pieces, ids, log_prob, perturbed, log_inclusion, decoded): up to k distinct segmentations of each whole text.

    ids are little-endian unsigned 16-bit piece ids; log_prob is the segmentation's under the lattice's weights;
    log_inclusion is the log of the chance that its perturbed value passes the threshold, 1 - exp(-exp(log_prob -
    threshold)), 0 if the text has no more than k segmentations; decoded tells that the ids give the text back.
    Texts with fewer than k segmentations give what there are; null and empty texts give one empty sample.
    Samples are a hash of seed and the row's key: repeated rows are sampled alike, null keys as one key. Other
    columns are ignored. Memory goes with a text's length and TOGETHER, not with the table.
    """
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattices(model, temperature)
        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
                    size += len(texts[end])
                    end += 1
                some, ids = texts[start:end], b["doc_id"].iloc[start:end]
                keys = (mix(b["hash"].iloc[start:end].to_numpy().astype(np.int64).astype(np.uint64) + np.uint64(seed))).tolist()
                found = sample_texts(lat, some, keys, k)
                back, at, out = lat.decoded([x[0] for leaves in found for x in leaves]), 0, []
                for d, t, leaves in zip(ids, some, found):
                    plain = t.replace(SPACE, " ").encode("utf-8", "replace")
                    for i, (x, lp, g, inc) in enumerate(leaves):
                        out.append((d, i, len(x), x.astype("<u2").tobytes(), lp, g, inc, back[at] == plain))
                        at += 1
                yield pd.DataFrame(out, columns=["doc_id", "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion", "decoded"])
                start = end
                del found, back, out
            release()
        lat.clear()  # the worker goes on with other work
        release()

    rows = in_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("hash"))
    return rows.mapInPandas(each, f"doc_id {kind}, {_OUT}")
