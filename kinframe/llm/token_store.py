"""A content-addressed store of token ids: rolling-hash chunks kept once, recipes and Merkle roots to verify them.

Layout of a store (Parquet): ``chunks/kind=chunk`` has hash (sha256 of data), n and data (ids, little-endian
unsigned 16 bit, or 32 bit for larger vocabularies), each hash once; ``manifest`` has a row a document in
ascending key order: doc_id, start, n_tokens, hashes (32 bytes each), lengths (32-bit counts) and merkle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import BASE, Table, mix
from .shared import in_batches, new_path, parts, prefix_sums

#: Mean, least and largest ids of a chunk, and ids that the rolling hash covers.
MEAN, LEAST, MOST, SPAN = 512, 128, 4096, 16
#: Words whose ids a worker remembers.
REMEMBERED = 2_000_000
#: A run of these behind letters is a token run of its own.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Store:
    path: str
    width: int  # bytes of an id

    @property
    def chunks(self) -> str:
        return f"{self.path}/chunks"

    @property
    def manifest(self) -> str:
        return f"{self.path}/manifest"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: For two independent hashes of a word: a number for each byte, and the base.
_CODES = mix(np.arange(1, 513, dtype=np.uint64)).reshape(2, 256)
_CODES[:, _SPACE] = 0
_BASES = (BASE, 0xD1342543DE82EF95)


class Encoder:
    """Whole texts to ids by the tokenizers library, word by word where that is the same.

    A word_bpe vocabulary drops white space, lowers letters and never joins letters over white space, so a text's
    ids are its words' ids in a row; each distinct word goes through the library once while a worker remembers it.
    Words are found by two 64-bit hashes; texts with a word whose hashes disagree, texts that hold a special token's
    string, and any vocabulary without an end-of-word suffix, are encoded as a whole.
    """

    def __init__(self, path: str, width: int):
        self.tok, self.kind = _tokenizer(path), f"<u{width}"
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.by_word = bool(suffix)
        if suffix:
            vocabulary = self.tok.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets the words."""
        self.table, self.size, self.used = Table(22), 0, 0
        self.other, self.at, self.many = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=self.kind)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; those of letters only go through the library together, a word's end shown by its last id."""
        texts = b"\n".join(words).decode("utf-8").split("\n")  # words hold no line ends
        cut = []
        known: dict[str, bytes] = {}
        for t in texts:
            base = t
            if not t.isalpha():
                base = t.rstrip(_PUNCTUATION)
                if not base or len(base) == len(t) or not base.isalpha():
                    base = t
            cut.append((base, t[len(base) :]))
        need = dict.fromkeys(x for both in cut for x in both if x)
        letters = [t for t in need if t.isalpha() and (t.isascii() or t.lower().isalpha())]
        rest = [t for t in need if not (t.isalpha() and (t.isascii() or t.lower().isalpha()))]
        runs = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        width = np.dtype(self.kind).itemsize
        for some, ids in zip(runs, self._plain([" ".join(x) for x in runs]) if runs else ()):
            ids = np.array(ids, dtype=self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(cuts) == len(some) and cuts[-1] == width * len(ids):
                data, at = ids.tobytes(), 0
                for t, c in zip(some, cuts):
                    known[t] = data[at:c]
                    at = c
            else:
                rest += some
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for t, ids in zip(some, self._plain(some)):
                known[t] = np.array(ids, dtype=self.kind).tobytes()
        known[""] = b""
        return [known[a] + known[b] for a, b in cut]

    def _add(self, keys: np.ndarray, other: np.ndarray, ids: list[bytes]) -> None:
        """Remembers words by their hashes."""
        width = np.dtype(self.kind).itemsize
        many = np.array([len(x) // width for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype=self.kind)
        size, used = self.size + len(keys), self.used + len(flat)
        room = lambda a, need: a if need <= len(a) else np.concatenate((a, np.zeros(max(need, len(a) * 2) - len(a), dtype=a.dtype)))
        self.other, self.at, self.many, self.ids = room(self.other, size), room(self.at, size), room(self.many, size), room(self.ids, used)
        self.other[self.size : size], self.many[self.size : size] = other, many
        self.at[self.size : size] = self.used + np.cumsum(many) - many
        self.ids[self.used : used] = flat
        self.table.put(keys, np.arange(self.size, size))
        self.size, self.used = size, used

    def all_of(self, data: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (in UTF-8); new words of all of them are learned together."""
        if not self.by_word:
            return [np.array(self._plain([d.decode("utf-8")])[0], dtype=self.kind) for d in data]
        if self.size > REMEMBERED:
            self.clear()
        whole = np.array([any(s in d for s in self.special) for d in data], dtype=bool)
        joined = b" ".join([b"" if w else d for d, w in zip(data, whole)]) + b" "
        b = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
        space = _SPACE[b]
        starts = np.flatnonzero(~space & np.append(True, space[:-1]))
        if len(starts):
            ends = np.flatnonzero(space & np.append(False, ~space[:-1]))
            begin = np.cumsum([0, *((1 if w else len(d) + 1) for d, w in zip(data, whole))])
            per_text = np.searchsorted(starts, begin)
            place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
            longest = int(place.max()) + 1
            h, other = (np.add.reduceat(codes[b[starts[0] :]] * np.cumprod(np.full(longest, base, dtype=np.uint64))[place], starts - starts[0]) for codes, base in zip(_CODES, _BASES))
            h = mix(h) | np.uint64(1)
            hit, word = self.table.get(h)
            if not hit.all():
                miss = np.flatnonzero(~hit)
                keys, one = np.unique(h[miss], return_index=True)
                one, low = miss[one], b.tobytes()
                self._add(keys, other[one], self._learn([low[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())]))
                word[miss] = self.table.get(h[miss])[1]
            unlike = np.flatnonzero(self.other[word] != other)
            if len(unlike):
                whole[np.searchsorted(per_text, unlike, side="right") - 1] = True
            many = self.many[word]
            until = np.concatenate(([0], np.cumsum(many)))
            flat = self.ids[np.repeat(self.at[word] - until[:-1], many) + np.arange(int(until[-1]))]
            bounds = until[per_text].tolist()
        else:
            flat, bounds = np.empty(0, dtype=self.kind), [0] * (len(data) + 1)
        return [np.array(self._plain([d.decode("utf-8")])[0], dtype=self.kind) if w else flat[i:j] for d, w, i, j in zip(data, whole.tolist(), bounds[:-1], bounds[1:])]

    def __call__(self, text: str) -> bytes:
        return self.all_of([text.encode("utf-8")])[0].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where a hash of the last SPAN ids says so, so that equal runs of ids are cut alike."""
    n = len(ids)
    h, k, base = ids.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while k < SPAN and len(h) > k:  # h[i] covers k ids from i on
        h = h[:-k] * np.uint64(pow(base, k, 1 << 64)) + h[k:]
        k *= 2
    marks = np.flatnonzero((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) & np.uint64(MEAN - 1) == 0) + k if k == SPAN else []
    out, last = [], 0
    for m in marks:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST:
            last = int(m)
            out.append(last)
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out + [n] if n > last else out


def merkle(hashes: bytes) -> bytes:
    """The root over 32-byte leaves; an odd one goes up as it is."""
    level = [hashes[i : i + 32] for i in range(0, len(hashes), 32)] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_ROWS = "kind string, doc_id {}, n long, hash binary, data binary, lengths binary, merkle binary"


def _encode(vocabulary: str, width: int, end_id: int, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind, seen = encoder(vocabulary, width), f"<u{width}", set()
        end = np.asarray([end_id], dtype=kind)
        sha = hashlib.sha256

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for first, last in _runs(texts, 2_000_000):
                out = []
                for key, ids in zip(keys[first:last], enc.all_of(texts[first:last])):
                    ids = np.append(ids, end)
                    data, at, hashes, ends = ids.tobytes(), 0, [], cuts(ids)
                    for c in ends:
                        x = data[at * width : c * width]
                        hashes.append(d := sha(x).digest())
                        if d not in seen:  # a copy inside this task never leaves it
                            seen.add(d)
                            out.append(("chunk", None, c - at, d, x, None, None))
                        at = c
                    joined = b"".join(hashes)
                    lengths = np.diff(np.array(ends, dtype="<u4"), prepend=np.uint32(0)).tobytes()
                    out.append(("recipe", key, at, joined, None, lengths, merkle(joined)))
                if len(seen) > 500_000:
                    seen.clear()
                yield flush(out)

    return rows


def _runs(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of some ``most`` bytes, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One chunk of each hash: rows come in the order of kind and hash, a hash's chunks all in this task."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        kind, h = b.column("kind"), b.column("hash")
        chunk = pc.equal(kind, "chunk").to_numpy(zero_copy_only=False)
        copy = np.zeros(b.num_rows, dtype=bool)
        copy[1:] = pc.equal(h.slice(1), h.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        copy[0] = h[0].as_py() == before
        before = h[-1].as_py() if chunk[-1] else None
        yield b.filter(pa.array(~(copy & chunk)))


def write_store(docs: DataFrame, vocabulary: str, end_id: int = 1, width: int = 2, key: str = "doc_id", text: str = "text", path: str | None = None) -> Store:
    """Encodes every whole text, appends end_id and writes a store.

    Null texts are empty: their document is the end id alone. Repeated rows and keys each get a recipe, null
    keys come first, other columns are ignored, an empty table gives an empty store. Texts are encoded once;
    chunks are shuffled by hash (without the copies inside a task), recipes by their row, so that a chunk which
    many documents share burdens no task.
    """
    spark = docs.sparkSession
    store = Store(path or new_path(spark, "tokens"), width)
    rows = in_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = _ROWS.format(rows.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(kind))
    made = rows.mapInArrow(_encode(vocabulary, width, end_id, schema), kind)
    made = made.repartition(parts(docs), F.when(F.col("kind") == "chunk", F.xxhash64("hash")).otherwise(F.xxhash64("doc_id", "hash")))
    made = made.sortWithinPartitions("kind", "hash")
    made.mapInArrow(_once, kind).write.partitionBy("kind").option("compression", "zstd").parquet(store.chunks)
    recipes = _chunk_table(spark, store, kind).where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), F.col("hash").alias("hashes"), "lengths", "merkle")
    placed = prefix_sums(recipes, ["doc_id", "hashes"], {"start": F.col("n_tokens")}, "recipes").select("doc_id", "start", "n_tokens", "hashes", "lengths", "merkle")
    placed.repartitionByRange(parts(docs), "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(store.manifest)
    return store


def _chunk_table(spark: SparkSession, store: Store, ddl: str | None = None) -> DataFrame:
    return spark.read.schema(ddl or "n long, hash binary, data binary, kind string").parquet(store.chunks)


def _recipes(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.parquet(store.manifest)


_POLY = np.uint32(0xEDB88320)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bits in its order."""
    p, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        p ^= b * ((a >> np.uint32(k)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (_POLY * (b & np.uint32(1)))
    return p


def shift_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What crc adds to the CRC-32 of a string in which so many bytes come after: the whole is the xor of its parts."""
    p, x, bits = crc.astype(np.uint32), np.full(1, 1 << 30, dtype=np.uint32), after.astype(np.uint64) << np.uint64(3)
    while bits.any():  # x is X^(2^k)
        odd = (bits & np.uint64(1)).astype(bool)
        p[odd] = _multiply(np.broadcast_to(x, int(odd.sum())), p[odd])
        x, bits = _multiply(x, x), bits >> np.uint64(1)
    return p


def digests(spark: SparkSession, store: Store) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, n_chunks, verified.

    Each chunk is read and hashed once where it lies; only its length, CRC-32 and whether its content fits its
    address go to the recipes, and CRCs are combined by place. verified: all chunks found and true, the Merkle
    root fits. ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    width = store.width

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha, crc32 = hashlib.sha256, zlib.crc32
        for b in batches:
            data = b["data"].tolist()
            ids = np.frombuffer(b"".join(data), dtype=f"<u{width}").astype("<u4").tobytes()
            ends = np.cumsum([len(x) // width for x in data]) * 4
            pieces = zip([0, *ends[:-1].tolist()], ends.tolist())
            yield pd.DataFrame(
                {
                    "hash": b["hash"],
                    "crc": np.array([crc32(ids[i:j]) for i, j in pieces], dtype=np.int64),
                    "true": np.array([sha(x).digest() == h and len(x) == n * width for h, x, n in zip(b["hash"].tolist(), data, b["n"].tolist())], dtype=bool),
                }
            )

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes, lengths, n = b["hashes"].tolist(), b["lengths"].tolist(), b["n_tokens"].to_numpy()
            many = np.array([len(x) // 4 for x in lengths], dtype=np.int64)
            each = np.frombuffer(b"".join(lengths), dtype="<u4").astype(np.int64)
            until = np.cumsum(many)
            sums = np.concatenate(([0], np.cumsum(each)))
            whole = sums[until] - sums[until - many]
            fits = np.array([len(h) == 32 * k and merkle(h) == m for h, k, m in zip(hashes, many.tolist(), b["merkle"].tolist())], dtype=bool) & (whole == n)
            after = np.repeat(n + sums[until - many], many) - sums[1:]  # ids that come after
            out = b[["doc_id", "start", "n_tokens"]].loc[b.index.repeat(many)].reset_index(drop=True)
            joined = b"".join([h.ljust(32 * k, b"\0")[: 32 * k] for h, k in zip(hashes, many.tolist())])
            out["hash"] = [joined[i : i + 32] for i in range(0, len(joined), 32)]
            yield out.assign(after=after, fits=np.repeat(fits, many))

    @F.pandas_udf("long")
    def part(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shift_crc(crc.to_numpy(), 4 * after.to_numpy()).astype(np.int64))

    chunks = _chunk_table(spark, store).where("kind = 'chunk'").select("hash", "data", "n").mapInPandas(check, "hash binary, crc long, true boolean")
    recipes = _recipes(spark, store)
    kind = recipes.schema["doc_id"].dataType.simpleString()
    refs = recipes.mapInPandas(spread, f"doc_id {kind}, start long, n_tokens long, hash binary, after long, fits boolean")
    found = refs.join(chunks, "hash", "left").withColumn("part", part(F.coalesce("crc", F.lit(0)), F.col("after")))
    return found.groupBy("doc_id", "start", "n_tokens").agg(
        F.bit_xor("part").alias("ids_crc32"), F.count(F.lit(1)).alias("n_chunks"), F.min(F.coalesce(F.col("true"), F.lit(False)) & F.col("fits")).alias("verified")
    )


def read_documents(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, start, ids array<int>) put together again from the store."""
    refs = _recipes(spark, store).select("doc_id", "start", F.posexplode(F.sequence(F.lit(1), F.length("hashes") - 31, F.lit(32))).alias("i", "at"), "hashes")
    refs = refs.select("doc_id", "start", "i", F.substring("hashes", F.col("at"), F.lit(32)).alias("hash"))
    data = refs.join(_chunk_table(spark, store).where("kind = 'chunk'").select("hash", "data"), "hash")
    whole = data.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("c"))
    kind = f"<u{store.width}"

    @F.pandas_udf("array<int>")
    def ids(c: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(x["data"], dtype=kind) for x in each]).astype(np.int32) for each in c])

    return whole.select("doc_id", "start", ids("c").alias("ids"))
