"""Thresholds of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlignConfig:
    """Script alignment. Seconds, or shares of a line's duration."""

    missing_coverage: float = 0.15
    mismatch_coverage: float = 0.15
    unclaimed_coverage: float = 0.30
    min_extra_s: float = 0.6
    min_line_s: float = 0.35
    max_offset_s: float = 5.0
    min_anchors: int = 3
    sync_warn_s: float = 0.75
    tolerance_s: float = 0.5

    @property
    def aligned_coverage(self) -> float:
        """The share of a line that must be covered at this tolerance."""
        return max(0.2, min(0.8, 1.0 - 0.5 * self.tolerance_s))


@dataclass(frozen=True)
class VadConfig:
    on: float = 0.5
    off: float = 0.35
    min_speech_s: float = 0.09
    min_silence_s: float = 0.12
    pad_s: float = 0.12


@dataclass(frozen=True)
class LevelConfig:
    silence_db: float = -60.0
    quiet_db: float = -45.0
    relative_db: float = 12.0
    hot_db: float = -1.0
    min_lines: int = 4
    pad_s: float = 0.35


@dataclass(frozen=True)
class NameConfig:
    accept: float = 0.55
    tokens: float = 0.85
    glued: float = 0.75
    glued_length: int = 4
    roster_accept: float = 0.80
    roster_generic: float = 0.92
    ambiguity: float = 0.06


@dataclass(frozen=True)
class MappingConfig:
    owner_precision: float = 0.50
    strong_precision: float = 0.50
    rescue_recall: float = 0.30
    rescue_precision: float = 0.25
    flag_precision: float = 0.35
    margin: float = 0.15
    group_recall: float = 0.50
    bit_lines: int = 6
    bit_seconds: float = 30.0
    absent_recall: float = 0.15
    twin_name: float = 0.75
    twin_fuzzy: float = 0.40
    twin_precision: float = 0.50
    twin_recall: float = 0.15


@dataclass(frozen=True)
class SequenceConfig:
    band_s: float = 25.0
    gap: float = 0.35
    min_sim: float = 0.50
    merge_cost: float = 0.05


@dataclass(frozen=True)
class GateConfig:
    long_span_s: float = 12.0
    slot_occupied: float = 0.40
    nearby_s: float = 10.0
    local_window_s: float = 3.0
    drift_clamp_s: float = 3.0
    block_gap_s: float = 10.0
    block_min: int = 4
    block_slot: float = 0.35
    cluster_gap_s: float = 60.0
    cluster_edge_s: float = 15.0
    reprise_words: int = 3
    reprise_share: float = 0.75
    fill_silence_db: float = -22.0
    fill_flat_db: float = 22.0
    sung_window_s: float = 4.0
    sung_margin_db: float = -4.0


ALIGN, VAD, LEVEL, NAMES, MAPPING, SEQUENCE, GATES = AlignConfig(), VadConfig(), LevelConfig(), NameConfig(), MappingConfig(), SequenceConfig(), GateConfig()
