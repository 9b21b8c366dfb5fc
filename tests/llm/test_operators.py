"""The training-data operators against brute force, round trips and SQL on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.llm import decontaminate as dc
from kinframe.llm import embedding_dedup as ed
from kinframe.llm import queries as Q
from kinframe.llm import hashing, segment_sampling, shared, sharding, simhash, suffix_dedup, token_counts, token_store, toxicity, url_filter
from tests.oracle import connect, same

from .brute import repeated, union_find

SF = "/root/testdata/sf0.001"
WORD_BPE, PIECES = Q.tokenizer_path("word_bpe_49k.json"), Q.tokenizer_path("piece_bpe_32k.model")
#: Texts that every operator on documents must bear: nulls, empty, copies, long, odd characters.
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "It's a TEST, don't!"), (4, "It's a TEST, don't!"), (None, "no key here"), (5, "word " * 30_000), (6, "x" * 20_000), (7, "汉字 é ß \u2581 <|endoftext|> \x1c\x85 a\u00a0b"), (8, "It's a TEST, don't!")]


def odd(spark):
    """ODD with columns whose names clash with the operators' own."""
    cols = ["hash", "fp", "score", "text2", "start", "component", "n", "h", "i", "key", "size", "shard", "sha", "doc"]
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in cols})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(spark, Q.queries()[name], Q.oracle_sql()[name], SF, con)


# --- shared ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("last", [0, 50_000])
def test_components(spark, last):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(9, 9)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long"), last).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert shared.components(spark.createDataFrame([], "a long, b long"), last).count() == 0


def test_prefix_sums(spark):
    rows = [(i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r.id: (r.before, r._total_before) for r in shared.prefix_sums(df, ["id"], {"before": F.col("v")}).collect()}
    at = 0
    for i, v in rows:
        assert got[i] == (at, sum(x for _, x in rows))
        at += v


# --- op1 ---------------------------------------------------------------------------------------------------


def test_encoder_equals_library(spark):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(WORD_BPE), token_store.Encoder(WORD_BPE, 2)
    texts = [r.text for r in documents(spark).collect()] + [t or "" for _, t in ODD] + ["'tis the dog's", "İ ΣΑΣ. ǅ ﬁ Å ́x", "a,b.c!! ..;"]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(enc(t), dtype="<u2").tolist() for t in texts] == want


@pytest.mark.parametrize("which", ["odd", "documents", "empty"])
def test_store_round_trip(spark, which):
    from tokenizers import Tokenizer

    df = {"odd": odd, "documents": documents, "empty": empty}[which](spark)
    store = token_store.write_store(df, WORD_BPE)
    tok, rows = Tokenizer.from_file(WORD_BPE), [(r.doc_id, r.text or "") for r in df.collect()]
    ids = [(d, tok.encode(t, add_special_tokens=False).ids + [1]) for d, t in rows]
    key = lambda x: (x[0] is not None, x[0] or 0)
    got = sorted(token_store.digests(spark, store).collect(), key=lambda r: r.start)
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, len(x), crc(x)) for d, x in ids), key=str)
    assert [key((r.doc_id,)) for r in got] == sorted(key((r.doc_id,)) for r in got) and all(r.verified for r in got)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    back = token_store.read_documents(spark, store).collect()
    assert sorted(((r.doc_id, r.ids) for r in back), key=str) == sorted(ids, key=str)
    chunks = token_store._chunk_table(spark, store).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_store_finds_damage(spark):
    store = token_store.write_store(documents(spark), WORD_BPE)
    bad = spark.read.parquet(store.chunks).withColumn("data", F.when(F.col("n") % 5 == 0, F.concat("data", F.lit(b"\0\0"))).otherwise(F.col("data")))
    hurt = token_store.Store(shared.new_path(spark, "hurt"), 2)
    bad.write.partitionBy("kind").parquet(hurt.chunks)
    spark.read.parquet(store.manifest).write.parquet(hurt.manifest)
    assert {r.verified for r in token_store.digests(spark, hurt).collect()} == {True, False}


def test_chunks_of_equal_runs_and_crc(spark):
    rng = np.random.default_rng(0)
    run = rng.integers(0, 49_000, 5000).astype("<u2")
    a, b = np.concatenate([run[:100], run]), np.concatenate([run[:900][::-1], run])
    pieces = lambda x: {x[i:j].tobytes() for i, j in zip([0, *token_store.cuts(x)], token_store.cuts(x))}
    assert len(pieces(a) & pieces(b)) >= 0.7 * len(pieces(a))
    assert token_store.cuts(run)[-1] == 5000 and max(np.diff([0, *token_store.cuts(np.zeros(9000, dtype="<u2"))])) <= token_store.MOST
    x, y = b"left part", b"right" * 99
    part = int(token_store.shift_crc(np.array([zlib.crc32(x)]), np.array([len(y)]))[0])
    assert part ^ zlib.crc32(y) == zlib.crc32(x + y)
    assert token_store.merkle(b"") != token_store.merkle(b"a" * 32)


# --- op2 ---------------------------------------------------------------------------------------------------


def test_masks_find_every_alignment():
    hit = lambda n, bad: any(all(i + o not in bad for o in m) for m in dc.MASKS for i in range(n - max(m)))
    for n in range(5, 16):
        for bad in combinations(range(n), n - math.ceil(0.8 * n)):
            assert hit(n, set(bad)), (n, bad)
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(16, 70)
        assert hit(n, set(rng.sample(range(n), n // 5)))


@pytest.mark.parametrize("seeds", [dc.BROADCAST_SEEDS, 0])
def test_decontamination(spark, seeds):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(20)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    swap = lambda w, at: [f"x{i}" if i in at else v for i, v in enumerate(w)]
    docs = {1: text(50) + item + text(9), 2: text(5) + swap(item, {3, 8, 12, 19}) + text(5), 3: text(5) + swap(item, {1, 3, 8, 12, 19}) + text(5), 4: item[4:], 5: item[5:], 6: text(300), 7: item * 2, 8: item[:4]}
    df = spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in docs.items()] + [(9, None), (10, "")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, ", ".join(item)), (1, ", ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_match, r.doc_word) for r in dc.contaminated(df, tests, broadcast_seeds=seeds).collect()}
    assert got == {1: (1, 20, 50), 2: (1, 16, 5), 4: (1, 16, -4), 7: (1, 20, 0)}
    assert sorted(r.doc_id for r in dc.decontaminate(df, tests, broadcast_seeds=seeds).collect()) == [3, 5, 6, 8, 9, 10]


def test_decontamination_odd(spark):
    tests = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.contaminated(odd(spark), tests).count() == 0
    out = dc.decontaminate(odd(spark), tests)
    assert out.count() == len(ODD) and out.columns == odd(spark).columns
    assert dc.contaminated(empty(spark), tests).count() == 0 and dc.contaminated(odd(spark), tests.limit(0)).count() == 0


# --- op3 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return segment_sampling.Lattices(PIECES, 1.0)


def every(lat, text):
    """log-probability of every segmentation."""
    s, out = segment_sampling.SPACE + text.replace(" ", segment_sampling.SPACE), {}

    def go(i, ids, w):
        if i == len(s):
            out[tuple(ids)] = w
            return
        alone = s[i] not in lat.ids
        for j in range(i + 1, min(len(s), i + lat.longest) + 1):
            if s[i:j] in lat.ids:
                go(j, [*ids, lat.ids[s[i:j]]], w + lat.score[s[i:j]])
        if alone:
            b = s[i].encode()
            go(i + 1, [*ids, *(lat.byte_ids[x] for x in b)], w + lat.byte_score * len(b))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: v - z for k, v in out.items()}


def test_sampling_without_replacement(lattice):
    text, n = "on it\n", 6000
    p = every(lattice, text)
    first, pairs, estimate = Counter(), Counter(), []
    keys = hashing.mix(np.arange(n, dtype=np.uint64)).tolist()
    for r in segment_sampling.sample_texts(lattice, [text] * n, keys, 3):
        a, b, c = (tuple(x[0].tolist()) for x in r)
        assert len({a, b, c}) == 3 and r[0][2] > r[1][2] > r[2][2]
        assert abs(r[0][1] - p[a]) < 1e-9
        first[a] += 1
        pairs[a, b] += 1
        estimate.append(sum(math.exp(x[1] - x[3]) * len(x[0]) for x in r))
    for a, q in p.items():
        assert abs(first[a] / n - math.exp(q)) < 0.02
    for (a, b), k in pairs.most_common(5):
        want = math.exp(p[a] + p[b]) / (1 - math.exp(p[a]))
        assert abs(k / n - want) < 0.02
    assert abs(np.mean(estimate) - sum(math.exp(q) * len(k) for k, q in p.items())) < 0.05
    all_of_them = segment_sampling.sample_texts(lattice, [text], [7], len(p) + 3)[0]
    assert {tuple(x[0].tolist()) for x in all_of_them} == set(p) and all(x[3] == 0 for x in all_of_them)


def test_sampling_texts(spark, lattice):
    df = documents(spark).limit(60).select("doc_id", "text")
    got = segment_sampling.sample_segmentations(df, PIECES, k=2).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    ids = {}
    for r in got:
        x = np.frombuffer(r.ids, dtype="<u2").tolist()
        assert r.decoded and lattice.sp.decode(x) == texts[r.doc_id] and r.n_pieces == len(x)
        ids.setdefault(r.doc_id, set()).add(tuple(x))
    assert all(len(v) == 2 for v in ids.values()) and len(ids) == len(texts)
    again = segment_sampling.sample_segmentations(df.repartition(9), PIECES, k=2).collect()
    assert sorted((r.doc_id, r.sample, bytes(r.ids)) for r in again) == sorted((r.doc_id, r.sample, bytes(r.ids)) for r in got)


def test_sampling_odd(spark):
    got = segment_sampling.sample_segmentations(odd(spark), PIECES).collect()
    assert all(r.decoded for r in got)
    n = Counter(r.doc_id for r in got)
    assert n[1] == n[2] == 1 and n[4] == 4 and n[5] == n[6] == n[8] == n[None] == 2
    assert segment_sampling.sample_segmentations(empty(spark), PIECES).count() == 0


# --- op4 ---------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    good = [(i, lab, np.array(v, dtype=np.float64)) for i, v, lab in rows if i is not None and v is not None and lab is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return [(a[0], b[0]) for a, b in combinations(good, 2) if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= threshold]


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(60):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((n, [float(np.float32(x)) for x in c + rng.normal(size=16) * 0.3], int(g % 3)))
            n += 1
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(40)]
    n += 40
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, float("nan")] + [0.0] * 14, 1), (n + 3, rows[0][1], None), (n + 4, [1.0, float("inf")] + [0.0] * 14, 0), (n + 5, rows[0][1][:8], 0), (n + 6, [], 0), (n + 7, [None] + [1.0] * 15, 0)]
    links = brute_links(rows)
    degree = Counter(x for e in links for x in e)
    comp = union_find([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "vec": F.lit(2), "list": F.lit(3)})
    old = ed.PER_LIST, ed.BLOCK
    try:
        for ed.PER_LIST, ed.BLOCK in (old, (8, 7)):  # one list, and many lists and blocks
            got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicate_vectors(df).collect()}
            assert got == {i: (degree[i], comp[i], comp[i] == i) for i, _, _ in rows}
    finally:
        ed.PER_LIST, ed.BLOCK = old
    assert ed.near_duplicate_vectors(df.limit(0)).count() == 0
    assert len(links) > 1000


def test_embedding_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links = brute_links(rows)
    comp = union_find([r[0] for r in rows], links)
    got = {r.vec_id: r.component_id for r in Q.op4_embedding_dedup(spark, SF).collect()}
    assert got == comp


# --- op5 ---------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    some = docs.join(labels, "doc_id").where(toxicity.held_out())
    got = toxicity.toxicity(some, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    auc = np.mean([(s[y == 1] > v).mean() + 0.5 * (s[y == 1] == v).mean() for v in s[y == 0]])
    assert auc > 0.95 and ((s >= 0.5) == y).mean() > 0.97
    assert all(r.held_out and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    out = toxicity.toxicity(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id == 4} == {zlib.crc32(b"4") % 5 == 0}
    kept = toxicity.without_toxic(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_toxicity_without_labels(spark):
    docs = odd(spark)
    for labels in ([], [(4, 1, 1)], [(4, 0, None), (None, 1, 1)]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert toxicity.toxicity(docs, m).count() == len(ODD)
    assert toxicity.toxicity(empty(spark), m).count() == 0


# --- op6 ---------------------------------------------------------------------------------------------------


def test_urls(spark, con):
    urls = [
        (1, "http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "https://m.example.com/en/x?q#f", "m.example.com", "/en/x", "example.com/en/", "block"),
        (3, "https://a.b.com/fr", "a.b.com", "/fr", "com/", "allow"), (4, "x://h.net/es/", "h.net", "/es/", "net/es/", "block"), (5, "x://h.net/ese", "h.net", "/ese", None, "allow"),
        (6, "no scheme com/xxx", "", "", None, "block"), (7, None, "", "", None, "allow"), (8, "", "", "", None, "allow"), (9, "https://spam-farm.org?x", "spam-farm.org", "", None, "block"),
        (10, "https://cheap.org/loan", "cheap.org", "/loan", None, "block"), (11, "https://cheap.org/cheap", "cheap.org", "/cheap", None, "allow"), (12, "https://sussex.org/essex-winner", "sussex.org", "/essex-winner", None, "allow"),
        (13, "https://com", "com", "", None, "allow"), (14, "a://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (15, "a://x#y://z.com/", "x", "", None, "allow"), (None, "://K.com/\n", "k.com", "/\n", "com/", "allow"),
    ]
    df = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumns({"host": F.lit("clash"), "_h": F.lit(1)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == {u[0]: u[2:] for u in urls}
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# --- op7 ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash(spark, which):
    df = {"documents": documents, "odd": odd}[which](spark)
    rows = [(r.doc_id, plain_fingerprint(r.text, 4)) for r in df.collect()]
    named = [r for r in rows if r[0] is not None]
    links = [(a[0], b[0]) for a, b in combinations(named, 2) if bin(a[1] ^ b[1]).count("1") <= 4]
    comp = union_find([r[0] for r in named], links)
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted((d, f"{f:016x}", comp[d]) for d, f in named)
    assert len(got) == len(rows) and simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_are_exact(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(3)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = union_find(signed, [(x, y) for (x, a), (y, b) in combinations(zip(signed, fps), 2) if bin(a ^ b).count("1") <= 4])
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.links(df).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in found)
    assert union_find(signed, found) == want


def test_one_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "A b  c d e f"), (2, "something else entirely, with more words"), (None, "a b c d e f")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {1, 2, None}


# --- op8 ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "group"), [(60, 20_000), (90, 3)])
def test_suffix_dedup(spark, length, group):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    p1, p2, p3 = some(40), some(15), some(100)
    texts = [some(rng.randint(0, 60)) for _ in range(15)] + [some(20) + p1 + some(20) for _ in range(6)]
    texts += [p1[50:] + some(9) + p2 + p2, p2 + some(30), "a" * 300, "ab" * 200, p3, p3, p3[:200] + some(10) + p3[100:], None, "", some(5) + "a" * 150]
    texts += [some(12) + p1[:120] + some(13) + p1[60:]] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, length, group=group).collect()}
    assert got == dict(enumerate(repeated([(t or "").encode() for t in texts], length)))
    clean = {r.doc_id: r.text for r in suffix_dedup.deduplicated(df, length, group=group).collect()}
    for i, t in enumerate(texts):
        if got[i][0] == 0:
            assert clean[i] == t
        else:
            assert len(clean[i].encode()) <= len(t.encode()) - got[i][0]


def test_anchors_in_long_texts():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 3000, dtype=np.uint8).tobytes()
    old = suffix_dedup.BLOCK
    whole = suffix_dedup.anchors(data, 200)
    try:
        suffix_dedup.BLOCK = 512  # blocks give the same anchors
        assert (suffix_dedup.anchors(data, 200) == whole).all()
    finally:
        suffix_dedup.BLOCK = old
    for s in range(0, 2800, 13):  # every string holds an anchor's key
        assert ((whole >= s) & (whole + suffix_dedup.KEY <= s + 200)).any()


def test_suffix_odd(spark):
    got = suffix_dedup.suffix_dedup(odd(spark), 400).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[5].n_removed == 150_000 and by[5].n_spans == 1 and by[6].n_removed == 20_000 and by[1].n_bytes == 0
    assert by[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    out = suffix_dedup.deduplicated(odd(spark), 400)
    assert out.columns == odd(spark).columns and out.count() == len(ODD)
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


# --- op9 ---------------------------------------------------------------------------------------------------


def test_length_histogram(spark):
    lengths = [0, 3, 3, 5, 9, 9, 9, None]
    hist = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    plain = [x or 0 for x in lengths]
    for r in hist.collect():
        assert r.n_docs == plain.count(r.length) and r.docs_ge == sum(x >= r.length for x in plain)
        assert r.tokens_ge == sum(x for x in plain if x >= r.length) and r.truncated_total == sum(min(x, r.length) for x in plain)
        assert r.share_le == sum(x <= r.length for x in plain) / len(plain)
    asked = {r.context: (r.tokens, r.truncated_docs) for r in token_counts.truncated_totals(hist, [0, 4, 100]).collect()}
    assert asked == {c: (sum(min(x, c) for x in plain), sum(x > c for x in plain)) for c in (0, 4, 100)}
    assert {r.q: r.length for r in token_counts.quantiles(hist, [0.25, 0.5, 1.0]).collect()} == {0.25: 0, 0.5: 3, 1.0: 9}


def test_token_lengths(spark):
    import public_tokenizers as p

    path = Q.tokenizer_path("byte_bpe_50k.tiktoken")
    enc = token_counts._encoding(path, p.PATTERN)
    got = sorted(r.n_tokens for r in token_counts.token_lengths(odd(spark), path, p.PATTERN).collect())
    assert got == sorted(len(enc.encode_ordinary(t or "")) for _, t in ODD)
    assert token_counts.length_histogram(token_counts.token_lengths(empty(spark), path, p.PATTERN)).count() == 0
    whole = Q.op9_token_counts(spark, SF)
    assert whole.agg(F.sum("n_docs")).first()[0] == documents(spark).count()


# --- op10 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["documents", "odd", "empty"])
def test_shards(spark, which):
    df = {"documents": documents, "odd": odd, "empty": empty}[which](spark)
    rows = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    got = sorted(sharding.shard_by_bytes(df, 4).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.size, r.text_crc32) for r in got] == rows
    total, largest = sum(r[1] for r in rows), max([r[1] for r in rows], default=0)
    at, by = 0, {}
    for r in got:
        assert r.start == at and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
        at += r.size
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    for rs in by.values():
        assert [r.slot for r in rs] == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 4) <= largest
