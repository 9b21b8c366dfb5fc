"""Nulls, repeats, long texts, clashing names and hot groups of the training-data operators, against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kinframe.llm import decontaminate as dc
from kinframe.llm import embedding_dedup as ed
from kinframe.llm import queries as Q
from kinframe.llm import segment_sampling, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filter

from .brute import repeated, union_find

SF = "/root/testdata/sf0.001"
#: Names that operators and stages use for columns of their own.
CLASH = ["sha", "_sha", "kept", "_kept", "good", "_good", "toxic", "_toxic", "t", "_t", "fp", "bands", "component", "doc", "data", "hash", "score", "h", "i", "key", "node", "n"]


def clash(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# --- op7 ---------------------------------------------------------------------------------------------------


def test_links_pass_through_null_keys(spark, monkeypatch):
    """Rows without a key still link others: 0 - 3 - 4 - 15 and a chain of nulls between far ends."""
    chain = [sum(1 << i for i in range(0, 2 * k)) for k in range(9)]
    fps = [(1, 0), (None, 3), (None, 4), (2, 15), (None, 1 << 63), (3, (1 << 63) | 7 << 40)] + [(None if 0 < k < 8 else 100 + k, 0xABCDEF0123456789 ^ c) for k, c in enumerate(chain)]
    rows = spark.createDataFrame([(d, signed(f)) for d, f in fps], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: rows)
    got = simhash.near_duplicates(rows).collect()
    links = [(a, b) for (a, (_, x)), (b, (_, y)) in combinations(enumerate(fps), 2) if bin(x ^ y).count("1") <= 4]
    comp = union_find(range(len(fps)), links)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[comp[i]] = min(least.get(comp[i], d), d)
    want = Counter((d, f"{f:016x}", least.get(comp[i])) for i, (d, f) in enumerate(fps))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert {r.component_id for r in got if r.doc_id == 2} == {1} and {r.component_id for r in got if r.doc_id == 108} == {100}


@pytest.mark.parametrize(("own", "most", "radius"), [(64, 8_192, 4), (1, 3, 4), (1_000, 40, 4), (2, 5, 2), (4, 64, 6)])
def test_balls_over_prefixes(spark, own, most, radius):
    """Prefixes of any length, and prefixes that are made longer to the last bit, find the same links."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in range(8) for _ in range(4)} | set(range(40)))
    want = union_find(map(signed, fps), [(signed(a), signed(b)) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= radius])
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), radius, own, most).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= radius for a, b in found)
    assert union_find(map(signed, fps), found) == want


# --- op8 ---------------------------------------------------------------------------------------------------


def test_suffix_dedup_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op8_suffix_dedup(spark, SF).collect()}
    want = dict(zip((d for d, _ in rows), repeated([t for _, t in rows], 400)))
    assert got == want and sum(n > 0 for n, _, _ in want.values()) > 20


def test_suffix_dedup_gives_the_texts_left(spark, tmp_path):
    """Passages of over 50 words are gone from the texts if they have 400 bytes; shorter ones and clean texts stay."""
    rng = random.Random(6)
    some = lambda n, least=7, most=9: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(least, most))) for _ in range(n))
    long, short = some(60), some(55, 3, 5)
    assert len(long) >= 400 > len(short)
    # the cuts at the edges of the long passage leave half a character
    texts = [some(20) + "é" + long + some(5), some(9) + "è" + long, some(30) + short + some(8), short, some(80), long[:399], "", None, "a" * 500, "a" * 500]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int").write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.op8_suffix_dedup(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {r.doc_id: r for r in out.collect()}
    for i, (t, (n, _, sha)) in enumerate(zip(texts, repeated([(t or "").encode() for t in texts], 400))):
        assert (got[i].n_removed, got[i].kept_sha256) == (n, sha)
        if not n:
            assert got[i].text == t
    assert long[2:-2] not in got[0].text + got[1].text and short in got[2].text and short == got[3].text
    assert got[0].text in (texts[0].replace("é" + long, ""), texts[0].replace(long, "")) and got[8].text == got[9].text == ""


@pytest.mark.parametrize("group", [2, 100_000])
def test_hot_passages(spark, group):
    """A passage that most texts hold, periodic texts, zero bytes, and repeats that differ by what stands round them."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefg hijk\x00é") for _ in range(n))
    hot, near = some(150), some(90)
    texts = [some(rng.randint(0, 40)) + hot[rng.randint(0, 30) : 150 - rng.randint(0, 30)] + some(rng.randint(0, 40)) for _ in range(60)]
    texts += [some(9) + near + hot[:80] + some(5), near + hot[:79] + "zz", "xyz" * 120, "q" + "xyz" * 50, "\x00" * 200, "\x00" * 90 + some(20), hot + hot, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, 80, group=group).collect()}
    assert got == dict(enumerate(repeated([(t or "").encode() for t in texts], 80)))


# --- op3, op9: one very long unbroken text -------------------------------------------------------------------


def test_long_unbroken_texts(spark):
    import public_tokenizers as p

    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij") for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 100_000), (3, "汉" * 5_000)], "doc_id long, text string")
    got = segment_sampling.sample_segmentations(df, Q.tokenizer_path("piece_bpe_32k.model")).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 2, 3: 1} and all(r.decoded for r in got)  # the third can be cut in one way only
    assert len({(r.doc_id, bytes(r.ids)) for r in got}) == 5
    path = Q.tokenizer_path("byte_bpe_50k.tiktoken")
    lengths = sorted(r.n_tokens for r in token_counts.token_lengths(df.where("doc_id <> 1"), path, p.PATTERN).collect())
    enc = token_counts._encoding(path, p.PATTERN)
    assert lengths == sorted(len(enc.encode_ordinary(t)) for t in ("x" * 100_000, "汉" * 5_000))


# --- op4 ---------------------------------------------------------------------------------------------------


def test_embedding_repeats_and_null_keys(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0), (3, [-x for x in v], 0), (4, [2 * x for x in v], 0), (5, v, 1)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicate_vectors(df).collect())
    assert got == Counter({(1, 3, 1, True): 2, (2, 3, 1, False): 1, (4, 3, 1, False): 1, (None, 0, None, False): 1, (3, 0, 3, True): 1, (5, 0, 5, True): 1})


def test_joined_reaches_over_a_matrix():
    rng = np.random.default_rng(4)
    for _ in range(20):
        met = rng.random((9, 11)) < 0.12
        want = union_find(range(20), [(int(i), 9 + int(j)) for i, j in zip(*np.nonzero(met))])
        rows, cols = ed._joined(met)
        assert dict(enumerate(np.concatenate((rows, cols)).tolist())) == want


def test_index_has_many_lists(spark):
    """Also the smallest table has several lists and probes."""
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r.embedding for r in t.select("embedding").collect()], dtype=np.float64)
    assert len(ed.fit(x, max(ed.FEWEST, 0)).coarse) == ed.FEWEST


# --- op5 ---------------------------------------------------------------------------------------------------


def test_toxicity_equals_plain_compression(spark):
    """Scores with every window compressed anew, without what workers remember or batches."""
    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    press = []
    for d in (model.toxic, model.ordinary):
        z = zstandard.ZstdCompressionDict(d)
        press.append(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False))

    def score(text):
        size = [[len(c.compress(b" %b %b" % (w, toxicity.MARK))) for c in press] for w in toxicity.windows(text)]
        saved = [o - t if len(w) > 2 else 0 for w, (t, o) in zip(toxicity.windows(text), size)]
        n = [sum(t <= model.cover + over and s >= least for (t, _), s in zip(size, saved)) for over, least in toxicity.RULES]
        x = [*np.log1p(n), *(k / len(size) for k in n), np.log1p(len(size))] if size else [0.0] * toxicity.FEATURES
        return 1 / (1 + np.exp(-np.clip(((np.array(x) - model.mean) / model.scale) @ np.array(model.weights) + model.bias, -30, 30)))

    rows = docs.where("doc_id % 7 = 0").unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")}))
    for r in toxicity.toxicity(rows.select("doc_id", "text"), model).join(rows.select("doc_id", "text"), "doc_id").collect():
        assert abs(r.score - score(r.text)) < 1e-9
    repeats = rows.limit(3).unionByName(rows.limit(3))
    assert toxicity.toxicity(repeats, model).count() == repeats.count() and toxicity.toxicity(rows.limit(0), model).count() == 0


# --- op6, op2 ----------------------------------------------------------------------------------------------


def test_urls_long_and_repeated(spark):
    long = "http://a.org/" + "x" * 200_000 + "/porn"
    got = url_filter.judge_urls(clash(spark.createDataFrame([(1, long), (1, long), (2, "http://b.org/" + "free-" * 50_000)], "page_id long, url string"))).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == {(1, "block"): 2, (2, "allow"): 1}


def test_rows_are_judged_by_their_own_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = clash(spark.createDataFrame([(1, f"so {item} it is"), (1, "clean words here"), (None, f"so {item} it is"), (None, None), (2, ""), (3, f"{item} {item}")], "doc_id long, text string"))
    tests = clash(spark.createDataFrame([(1, item), (2, item)], "item_id long, text string"))
    for seeds in (dc.BROADCAST_SEEDS, 0):
        out = dc.decontaminate(docs, tests, broadcast_seeds=seeds)
        assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == {(1, "clean words here"): 1, (None, None): 1, (2, ""): 1}
        got = {(r.doc_id, r.item_id): r.doc_word for r in dc.contaminated(docs.where("doc_id = 3"), tests, broadcast_seeds=seeds).collect()}
        assert got == {(3, 1): 0, (3, 2): 0}  # the first of equal places


def test_repeated_words_and_short_items(spark):
    docs = [(1, "ha " * 3000), (2, "the quick fox"), (3, "a quick brown fox"), (4, "fox"), (5, "ha"), (6, "so ha ha ha it is"), (7, "ha " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(1, "ha " * 400), (2, "quick fox"), (3, "FOX!"), (4, "brown fox quick a"), (5, "ha ha ha ha"), (6, "a quick brown fox")], "item_id long, text string")
    want = {(1, 1): 0, (7, 1): 0, (2, 2): 1, (2, 3): 2, (3, 3): 3, (4, 3): 0, (3, 6): 0, (1, 5): 0, (7, 5): 0}
    for seeds in (dc.BROADCAST_SEEDS, 0):
        assert {(r.doc_id, r.item_id): r.doc_word for r in dc.contaminated(df, tests, broadcast_seeds=seeds).collect()} == want
        assert sorted(r.doc_id for r in dc.decontaminate(df, tests.where("item_id = 2"), broadcast_seeds=seeds).collect()) == [1, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        dc.contaminated(df, tests, similarity=0.7)


# --- op9, op10 ---------------------------------------------------------------------------------------------


def test_token_count_rows(spark):
    import public_tokenizers as p

    enc = token_counts._encoding(Q.tokenizer_path("byte_bpe_50k.tiktoken"), p.PATTERN)
    n = [len(enc.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {x: (k, k * x, sum(v >= x for v in n), sum(v for v in n if v >= x), sum(min(v, x) for v in n), sum(v <= x for v in n)) for x, k in Counter(n).items()}
    got = {r.length: (r.n_docs, r.n_tokens_total, r.docs_ge, r.tokens_ge, r.truncated_total, r.docs_le) for r in Q.op9_token_counts(spark, SF).collect()}
    assert got == want


def test_shard_rows(spark):
    rows = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    total, at, want, slots = sum(n for _, n, _ in rows), 0, {}, Counter()
    for d, n, crc in rows:
        shard = min(15, (2 * at + n) * 16 // (2 * total))
        want[d] = (n, crc, "bytes", shard, slots[shard], None)
        slots[shard] += 1
        at += n
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in Q.op10_sharding(spark, SF).collect()}
    assert got == want
    assert sharding.shard_by_bytes(clash(spark.read.parquet(f"{SF}/documents.parquet"))).count() == len(rows)


# --- the pipeline's stages ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, spark):
    """Labels and a benchmark for small tables of documents."""
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_odd_tables(spark, sf_dir, stage):
    name, f = P.STAGES[stage]
    rows = [(1, None), (2, ""), (None, None), (None, "no key here"), (3, "  \n"), (4, "same text again and again"), (4, "same text again and again"), (5, "same text again and again"), (6, "x" * 20_000), (7, "汉字 é ß ▁ <|endoftext|>"), (8, "word " * 20_000)]
    docs = clash(spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    out = f(spark, docs, sf_dir)
    got = out.collect()
    if name != "sentencepiece":
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in got for c in CLASH)
    if name == "simhash":  # 4 and 5 are copies, and the empty ones of 1 to 3; rows with null keys stay
        assert {r.doc_id for r in got} == {1, None, 4, 6, 7, 8} and sum(r.doc_id == 4 for r in got) == 2
    elif name != "sentencepiece":
        assert len(got) == len(rows)
    assert f(spark, docs.limit(0), sf_dir).count() == 0


def test_toxicity_stage_against_scores(spark):
    """What goes is what the operator's own query rejects when it learns from the same rows; all else stays unchanged."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rejected = {r.doc_id for r in Q.op5_toxicity(spark, "/root/testdata/sf0.01").where("predicted = 1").collect()}
    kept = {r.doc_id: tuple(r) for r in P.drop_toxic(spark, docs, "/root/testdata/sf0.01").collect()}
    every = {r.doc_id: tuple(r) for r in docs.collect()}
    assert kept == {d: r for d, r in every.items() if d not in rejected} and len(rejected) > 20
    toxic = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & rejected) > 0.6 * len(toxic) and not [t for t in kept.values() if re.search(r"\b(idiot|moron|scum)\b.*\b(trash|loser|stupid)\b", t[1] or "")]
