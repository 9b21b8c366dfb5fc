"""64-bit perceptual hash of 32 x 32 frames: low DCT frequencies against their median, in single precision."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

SIDE, BLOCK = 32, 8


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """cos((2x + 1) u pi / 64) for u = 1..8, with the DCT's scale, float32."""
    x = np.arange(SIDE)
    scale = np.float32(np.sqrt(2.0 / SIDE))
    return np.stack([(np.cos((2 * x + 1) * u * np.pi / (2 * SIDE))).astype(np.float32) * scale for u in range(1, BLOCK + 1)])


def hash_frames(frames: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of (n, 1024) uint8 frames.

    Sums run over pixels one after the other in float32, for all frames at once, so that results don't depend
    on how many frames are hashed together.
    """
    if frames.shape[1] != SIDE * SIDE:
        raise ValueError("a frame has 1024 bytes")
    c, f = _basis(), frames.reshape(-1, SIDE, SIDE).astype(np.float32)
    rows = np.zeros((len(f), SIDE, BLOCK), dtype=np.float32)  # (frame, y, u)
    for x in range(SIDE):
        rows += f[:, :, x, None] * c[None, None, :, x]
    out = np.zeros((len(f), BLOCK, BLOCK), dtype=np.float32)  # (frame, v, u)
    for y in range(SIDE):
        out += rows[:, y, None, :] * c[None, :, y, None]
    ac = out.reshape(-1, BLOCK * BLOCK)
    middle = np.sort(ac, axis=1)[:, 31:33]
    median = ((middle[:, 0] + middle[:, 1]) / np.float32(2.0)).astype(np.float32)
    bits = (ac > median[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)[None]
    return np.bitwise_or.reduce(bits, axis=1).astype(np.int64)


@F.pandas_udf(LongType())
def phash(frames: pd.Series) -> pd.Series:
    """Hash of a binary column of 1024-byte frames; null stays null."""
    ok = frames.notna()
    out = pd.Series([None] * len(frames), dtype="Int64", index=frames.index)
    if ok.any():
        out[ok] = hash_frames(np.frombuffer(b"".join(bytes(x) for x in frames[ok]), dtype=np.uint8).reshape(int(ok.sum()), -1))
    return out


@F.pandas_udf(ArrayType(LongType()))
def mirrored_hashes(frames: pd.Series) -> pd.Series:
    """Hashes of the mirrored frames of an array of binary ones, a position each; null for frames that aren't 32 x 32."""

    def each(some):
        if some is None:
            return None
        known = [bytes(f) if f is not None and len(f) == SIDE * SIDE else None for f in some]
        whole = [np.frombuffer(f, dtype=np.uint8).reshape(SIDE, SIDE)[:, ::-1].ravel() for f in known if f]
        made = iter(hash_frames(np.stack(whole)).tolist() if whole else [])
        return [next(made) if f else None for f in known]

    return frames.map(each)
