"""Settings of a scan: every knob, its limits and its presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np


@dataclass(frozen=True)
class ScanConfig:
    """All knobs. Percentages are 0-100, durations seconds, sizes as named; 0 switches a tolerance off."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    recursive: bool = True
    whole_catalog: bool = False
    images: bool = True
    positions: int = 1
    percent: float = 96.0
    use_phash: bool = False
    flipped: bool = False
    flipped_recall: str = "full"  # or "reference": probe the unflipped hash only
    ignore_black: bool = False
    ignore_white: bool = False
    duration_percent: float = 20.0
    duration_min_s: float = 0.0
    duration_max_s: float = 0.0
    size_percent: float = 0.0
    resolution_gate: bool = False
    folder_mode: str = "any"  # any, same, different
    folder_depth: int = 1
    skip_hard_links: bool = False
    min_size_mb: int | None = None
    max_size_mb: int | None = None
    must_match: tuple[str, ...] = ()
    must_not_match: tuple[str, ...] = ()
    skip_reparse_points: bool = False
    retry_errors: bool = False
    max_sampling_s: float = 0.0
    partial_clips: bool = False
    clip_min_ratio: float = 0.1
    clip_similarity: float = 0.8
    clip_visual_gate: bool = False
    clip_visual_similarity: float = 0.85
    blocking: str = "auto"  # auto, pigeonhole, lsh, duration, theta
    seed: int = 42

    def validate(self) -> ScanConfig:
        """Values outside their range are moved to its end."""
        clamp = lambda v, lo, hi: min(max(v, lo), hi)
        return replace(
            self,
            positions=int(clamp(self.positions, 1, 10)),
            percent=float(clamp(self.percent, 0, 100)),
            duration_percent=float(clamp(self.duration_percent, 0, 100)),
            duration_min_s=max(0.0, self.duration_min_s),
            duration_max_s=max(0.0, self.duration_max_s),
            size_percent=float(clamp(self.size_percent, 0, 100)),
            folder_depth=int(clamp(self.folder_depth, 1, 64)),
            clip_min_ratio=float(clamp(self.clip_min_ratio, 0.01, 0.94)),
            clip_similarity=float(clamp(self.clip_similarity, 0.0, 1.0)),
            max_sampling_s=max(0.0, self.max_sampling_s),
        )

    @property
    def limit(self) -> float:
        """Largest mean pixel difference that matches, in single precision."""
        return float(np.float32(1.0) - np.float32(self.percent) / np.float32(100.0))

    @property
    def max_bits(self) -> int:
        """Largest Hamming distance of 64-bit hashes that matches."""
        return int(np.floor((1.0 - float(np.float32(self.percent) / np.float32(100.0))) * 64))

    def position_list(self) -> list[float]:
        """i / (n + 1) for i = 1..n, summed up in single precision."""
        step, at, out = np.float32(1.0) / np.float32(self.positions + 1), np.float32(0.0), []
        for _ in range(self.positions):
            at = np.float32(at + step)
            out.append(float(at))
        return out

    @classmethod
    def from_dict(cls, values: dict) -> ScanConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}).validate()


#: What each preset changes.
PRESETS = {
    "fast": {"percent": 90.0, "duration_percent": 30.0, "images": False, "max_sampling_s": 30.0},
    "balanced": {"percent": 96.0, "duration_percent": 20.0},
    "precise": {"percent": 99.0, "duration_percent": 10.0, "positions": 3, "use_phash": True, "partial_clips": True, "clip_visual_gate": True, "flipped": True},
    "image_only": {"percent": 96.0, "duration_percent": 0.0},
    "audio_fingerprint": {"percent": 96.0, "duration_percent": 20.0, "partial_clips": True, "clip_visual_gate": True, "clip_min_ratio": 0.1, "clip_similarity": 0.8, "clip_visual_similarity": 0.85},
}


def preset(name: str) -> ScanConfig:
    return ScanConfig(**PRESETS[name]).validate()
