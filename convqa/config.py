"""Threshold sets. Unknown keys are reported and ignored, missing keys keep their default."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields
from typing import Any, Mapping, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class AudioConfig:
    interruption_seconds: float = 1.0
    human_channel: int = 0
    ai_channel: int = 1
    frame_ms: float = 20.0
    noise_floor_percentile: float = 20.0
    margin_db: float = 8.0
    min_speech_dbfs: float = -42.0
    min_speech_ms: float = 100.0
    speech_hangover_ms: float = 150.0
    overlap_merge_gap_ms: float = 120.0
    require_voiced: bool = True
    voicing_min: float = 0.45
    pitch_min_hz: float = 80.0
    pitch_max_hz: float = 300.0
    voice_band_hz: tuple[float, float] = (200.0, 3800.0)
    voice_band_min_ratio: float = 0.40
    min_voiced_ratio: float = 0.35

    @property
    def hangover_frames(self) -> int:
        return int(self.speech_hangover_ms / self.frame_ms)

    @property
    def merge_gap_frames(self) -> int:
        return int(self.overlap_merge_gap_ms / self.frame_ms)

    @property
    def min_speech_frames(self) -> int:
        return int(self.min_speech_ms / self.frame_ms)


@dataclass(frozen=True)
class CallConfig:
    transcript_min_turns: int = 2
    reply_latency_warn_ms: int = 6000
    reply_latency_max_ms: int = 0
    transcript_match_min: float = 0.95
    transcript_match_warn: float = 0.5
    conv_match_min: float = 0.75
    call_match_skew_ms: int = 15_000
    settle_ms: int = 5_000
    confirm_ms: int = 500
    turn_timeout_ms: int = 20_000


def load(cls: type[T], values: Mapping[str, Any]) -> T:
    """Build a threshold set from a dictionary such as a parsed JSON file."""
    known = {f.name for f in fields(cls)}
    for key in values.keys() - known:
        warnings.warn(f"ignoring unknown config key {key!r}", stacklevel=2)
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})
