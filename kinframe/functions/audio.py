"""Audio fingerprints: one 32-bit value a second from chroma features of mono 11025 Hz samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# fixed values
RATE, FRAME, HOP, SCALE = 11025, 4096, 1365, 32768.0
LOW_HZ, HIGH_HZ, NOTES = 27.5, 3520.0, 12
TAPS = (0.25, 0.5, 1.0, 0.5, 0.25)
QUIET = 1e-10
#: The notes that are compared for each bit: neighbours, minor thirds, tritones.
PAIRS = tuple((i, (i + step) % NOTES) for step, n in ((1, 12), (3, 12), (6, 8)) for i in range(n))


@lru_cache(maxsize=1)
def window() -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))


@lru_cache(maxsize=1)
def notes() -> np.ndarray:
    """The note of each frequency bin of a frame, -1 outside the range and for the first and last bin."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    octave = np.log2(np.maximum(hz, LOW_HZ / 2) / LOW_HZ)
    note = np.where((hz >= LOW_HZ) & (hz <= HIGH_HZ), np.floor(NOTES * (octave - np.floor(octave))), -1)
    note[[0, -1]] = -1
    return note.astype(np.int64)


def chroma(frames: np.ndarray) -> np.ndarray:
    """(n, 12) energies of (n, 4096) samples."""
    spectrum = np.fft.rfft(frames * window(), axis=1)
    energy, note = spectrum.real**2 + spectrum.imag**2, notes()
    return np.stack([energy[:, note == k].sum(axis=1) for k in range(NOTES)], axis=1)


def normalised(c: np.ndarray) -> np.ndarray:
    """Rows of unit length; quiet rows become zero."""
    power = (c * c).sum(axis=1, keepdims=True)
    return np.where(power < QUIET, 0.0, c / np.sqrt(np.maximum(power, QUIET)))


def smoothed(c: np.ndarray) -> np.ndarray:
    """Each row with the four before it, weighted; the first four give none."""
    if len(c) < len(TAPS):
        return np.zeros((0, c.shape[1]))
    n = len(c) - len(TAPS) + 1
    return sum(c[k : k + n] * t for k, t in enumerate(TAPS)) / sum(TAPS)


def bits(c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(c), dtype=np.int64)
    for k, (a, b) in enumerate(PAIRS):
        out |= (c[:, a] > c[:, b]).astype(np.int64) << k
    return out


def majority(values: np.ndarray) -> int:
    """The bits that more than half of the values have; none for no values."""
    if not len(values):
        return 0
    ones = ((values[:, None] >> np.arange(32)) & 1).sum(axis=0)
    return int(sum(1 << k for k in range(32) if ones[k] >= len(values) // 2 + 1))


def fingerprint(samples: np.ndarray) -> list[int]:
    """A value a second: frames every HOP samples vote in the second in which they start."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return []
    at = np.arange(n) * HOP
    frames = np.lib.stride_tricks.sliding_window_view(samples / SCALE, FRAME)[at]
    values = bits(normalised(smoothed(chroma(frames))))
    second = at[len(TAPS) - 1 :] // RATE
    return [majority(values[second == s]) for s in range(int(second[-1]) + 1)] if len(second) else []


@F.pandas_udf(ArrayType(LongType()))
def audio_fingerprint(pcm: pd.Series) -> pd.Series:
    """Fingerprint of binary little-endian 16-bit mono samples; null stays null, too short is empty."""
    return pd.Series([None if x is None else fingerprint(np.frombuffer(x, dtype="<i2")) for x in pcm])
