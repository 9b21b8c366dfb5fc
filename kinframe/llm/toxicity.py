"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, release

#: Bounds of the sample that fit() reads: rows a class, and the longest text in bytes that may be one of them.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 3000, 5000, 20_000
#: A window is one word between spaces and MARK, a longer run is cut; words whose lengths a worker remembers.
WINDOW_BYTES, DICT_BYTES, LEVEL, REMEMBERED = 64, 32_768, 3, 200_000
#: Both dictionaries end in MARK, so that even a short window is a compressed block and not a stored one, and
#: has the 8 bytes behind it that zstandard's search for matches needs.
MARK = bytes(range(1, 9)) + bytes(range(14, 32))
#: A word is trained on as toxic if so many toxic texts hold it, at such odds against ordinary texts.
LEAST_TEXTS, ODDS = 4, 20.0
#: (bytes over a known toxic word's length, bytes saved against the ordinary dictionary) that make a window toxic.
RULES = ((0, 2), (0, 3), (1, 3), (2, 3))
FEATURES = 2 * len(RULES) + 1
_PUNCTUATION = b".,;:!?\"'()[]{}<>|*&%$#@^~`+=_-/\\"


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    cover: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def windows(text: str | None) -> list[bytes]:
    """The whole text as windows: its words in ASCII lower case without punctuation round them; long ones are cut."""
    ws = [w.strip(_PUNCTUATION) for w in (text or "").encode("utf-8", "replace").lower().split()]
    if any(len(w) > WINDOW_BYTES for w in ws):
        ws = [w[i : i + WINDOW_BYTES] for w in ws for i in range(0, len(w), WINDOW_BYTES)]
    return ws


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@lru_cache(maxsize=2)
def _remembered(toxic: bytes, ordinary: bytes) -> dict[bytes, int]:
    return {}


def lengths(ws: list[bytes], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For each window its length compressed with the toxic dictionary, and what that saves against the ordinary one."""
    a, b, known = _compressor(toxic).compress, _compressor(ordinary).compress, _remembered(toxic, ordinary)
    if len(known) > REMEMBERED:
        known.clear()
    for w in ws:
        if w not in known:
            x = b" %b %b" % (w, MARK)
            n = len(a(x))
            saved = len(b(x)) - n if len(w) > 2 else 0  # shorter ones tell nothing
            known[w] = n << 16 | (saved + 1024)  # two small numbers in one
    both = np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws))
    return np.stack([both >> 16, (both & 0xFFFF) - 1024], axis=1)


def features(text: str | None, toxic: bytes, ordinary: bytes, cover: int) -> list[float]:
    """For each of RULES how many windows it makes toxic (log) and their share, and the log of the windows' count."""
    ws = windows(text)
    if not ws:
        return [0.0] * FEATURES
    d = lengths(ws, toxic, ordinary)
    n = [int(((d[:, 0] <= cover + over) & (d[:, 1] >= saved)).sum()) for over, saved in RULES]
    return [*np.log1p(n), *(k / len(ws) for k in n), float(np.log1p(len(ws)))]


def _distinct(texts: list[str]) -> list[str]:
    """Without near copies, which would make a text's chance words look common: none shares two of the six least shingle hashes."""
    seen: set[tuple[int, ...]] = set()
    out = []
    for t in texts:
        w = windows(t)
        s = sorted({zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:6]
        pairs = set(combinations(s, 2)) or {tuple(s)}
        if not pairs & seen:
            seen |= pairs
            out.append(t)
    return out


def _dictionary(words: Iterable[bytes]) -> bytes:
    """The dictionary's content: the words, the most telling ones last, where matches are cheapest; then MARK."""
    return b"".join(b" %b " % w for w in words)[-DICT_BYTES:] + MARK


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    a = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge * len(x) ** 0.5), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, a.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, int]:
    """The dictionaries, and the length at which a word counts as one of the toxic dictionary's."""
    in_t, in_n = (Counter(w for x in xs for w in set(windows(x)) if len(w) > 2) for xs in (toxic, ordinary))
    per = len(ordinary) / len(toxic)
    telling = [w for w, k in sorted(in_t.items(), key=lambda x: (x[1], x[0])) if k >= LEAST_TEXTS and k * per >= ODDS * (in_n[w] + 0.5)]
    known = set(telling)
    d_toxic = _dictionary(telling or [w for w, _ in sorted(in_t.items(), key=lambda x: (x[1], x[0]))])
    d_ordinary = _dictionary(w for w, _ in sorted(in_n.items(), key=lambda x: (x[1], x[0])) if w not in known)
    return d_toxic, d_ordinary, int(np.median(lengths(telling or list(in_t) or [b""], d_toxic, d_ordinary)[:, 0]))


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from all texts; weights and threshold from scores of texts that the dictionaries had not seen.

    The toxic dictionary is trained on the words that many more toxic texts hold than ordinary ones (all words
    if there are none), the ordinary one on the other words of ordinary texts. For the calibration each third of
    the texts is measured with dictionaries of the other two. Without texts of both kinds every score is the same.
    """
    if not toxic or not ordinary:
        return Model(MARK, MARK, 0, (0.0,) * FEATURES, (1.0,) * FEATURES, (0.0,) * FEATURES, 5.0 if toxic else -5.0)
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    x, y = [], []
    for fold in range(3):
        rest = [[t for i, t in enumerate(ts) if i % 3 != fold] or ts for ts in (toxic, ordinary)]
        d = _dictionaries(*rest)
        for label, ts in ((1.0, toxic), (0.0, ordinary)):
            x += [features(t, *d) for t in ts[fold::3]]
            y += [label] * len(ts[fold::3])
    x, y = np.array(x), np.array(y)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w, bias = _logistic((x - mean) / scale, y)
    return Model(*_dictionaries(toxic, ordinary), tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), bias)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled rows that aren't held out: at most SAMPLE_* rows a class, chosen by a hash of the key.

    Rows without a text or label, and texts over SAMPLE_BYTES, aren't learned from (they are scored all the
    same). A key with several labels counts as toxic if one says so.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("_y"))
    short = docs.where((F.octet_length(text) <= SAMPLE_BYTES) & F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("_text"))
    ids = [named.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(most) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    chosen = ids[0].unionByName(ids[1])  # 8000 rows at the most
    rows = sorted((r[0], r[1], r[2]) for r in short.join(F.broadcast(chosen), key).select(F.xxhash64(key), "_text", "_y").limit(2 * (SAMPLE_TOXIC + SAMPLE_ORDINARY)).collect())
    return train([t for _, t, y in rows if y == 1], [t for _, t, y in rows if y == 0])


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t, model.toxic, model.ordinary, model.cover) for t in texts]).reshape(-1, FEATURES)
            z = (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        _remembered(model.toxic, model.ordinary).clear()  # the worker goes on with other work
        release()

    return score


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone; nulls and empty texts score too."""
    out = in_batches(docs).select(F.col(key).alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), scorer(model)(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that the model rejects (null and empty texts stay), with their columns whatever their names."""
    return in_batches(docs).where(scorer(model)(F.col(text)) < 0.5)
