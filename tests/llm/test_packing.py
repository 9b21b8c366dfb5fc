"""Packing against optimal packings of small tables, and the rules of a packing on whole tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from kinframe.llm import packing as K
from kinframe.llm import queries as Q


def optimal(pieces, cap):
    """The fewest sequences, by trying each place for each piece."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for b in set(bins):
            if b + pieces[i] <= cap:
                k = bins.index(b)
                go(i + 1, bins[:k] + [b + pieces[i]] + bins[k + 1 :])
        go(i + 1, [*bins, pieces[i]])

    go(0, [])
    return best[0]


def used(found, cap):
    out = Counter()
    for filling, n in found:
        assert sum(x * c for x, c in filling) <= cap and n > 0
        for x, c in filling:
            out[x] += c * n
    return out, sum(n for _, n in found)


def test_small_tables_are_optimal():
    rnd = random.Random(2)
    for _ in range(300):
        cap = rnd.choice([10, 20, 30, 100])
        pieces = [rnd.randrange(1, rnd.choice([cap, cap // 2]) + 1) for _ in range(rnd.randrange(1, 12))]
        counts, n = used(K.completed(Counter(pieces), cap), cap)
        assert counts == Counter(pieces)
        assert K.lower_bound(Counter(pieces), cap) <= n == optimal(pieces, cap)


def test_branches_beat_best_fit():
    rnd = random.Random(3)
    pieces = Counter(rnd.randrange(1200, 1500) for _ in range(400))
    counts, n = used(K.completed(pieces, 4096, tries=2000), 4096)
    fit = sum(k for _, k in K.best_fit(pieces, 4096))
    assert counts == pieces and K.lower_bound(pieces, 4096) <= n < fit
    large = {x: 10**9 + x for x in (4096, 3000, 1096, 700, 5)}  # as many documents as may be
    counts, n = used(K.completed(large, 4096), 4096)
    rest = {x: c for x, c in large.items() if x < 4096}
    assert counts == large and K.lower_bound(rest, 4096) <= n - large[4096] <= sum(k for _, k in K.best_fit(rest, 4096))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_a_packing(spark, sf):
    from tokenizers import Tokenizer

    d = f"/root/testdata/{sf}"
    tok = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            want.append((r.doc_id, k // 4096, k, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))))
    got = Q.op11_best_fit_packing(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    whole(got)
    sizes = Counter(x[3] for x in want)
    full = sizes.pop(4096, 0)
    assert len({r.sequence_id for r in got}) == K.lower_bound(sizes, 4096) + full  # as few as any packing


def whole(rows, cap=4096):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= cap


def test_edges(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "one two"), (3, "word " * 9000), (4, "a b"), (4, "a b"), (4, "a b")]
    df = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, sequence_id string, offset int")
    pieces = K.token_pieces(df, Q.tokenizer_path("word_bpe_49k.json"))
    placed = K.packed(pieces)
    rows = placed.collect()
    whole(rows)
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in rows) == [(0, 0, 0, 3), (1, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 4096), (3, 1, 4096, 4096), (3, 2, 8192, 809), *[(4, 0, 0, 3)] * 3]
    assert len({r.sequence_id for r in rows}) == 3
    joined = {r.sequence_id: bytes(r.ids) for r in K.sequences(placed).collect()}
    for r in rows:
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert K.packed(pieces.where("false")).collect() == []
    with pytest.raises(ValueError):
        K.packed(pieces, capacity=100)
    other = spark.createDataFrame([(5, 60), (6, 60), (7, 40), (8, 40)], "sequence_id int, length int")
    found = K.packed(other, 100, order=("sequence_id",)).collect()
    whole(found, 100)
    assert len({r.sequence_id for r in found}) == 2
