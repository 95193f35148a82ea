"""Settings of the operators. Defaults are the protocol and rule values of the domain."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HeatSettings:
    """When a series counts as hot and how it is then cut in time."""

    max_rows: int = 2_000_000
    chunk_ms: float = 60_000.0
    broadcast_keys: int = 100_000


# Gap repair and physiological limits.
@dataclass(frozen=True)
class RepairSettings:
    min_mm: float = 1.0
    max_mm: float = 9.5
    min_confidence: float = 20.0
    max_gap_ms: float = 350.0
    edge_ms: float = 100.0
    inner_factor: float = 0.7
    inner_floor: float = 10.0
    edge_factor: float = 0.5


# Recording protocol.
@dataclass(frozen=True)
class ProtocolSettings:
    baseline_ms: float = 1500.0
    stimulus_ms: float = 200.0
    recovery_ms: float = 3500.0

    @property
    def total_ms(self) -> float:
        return self.baseline_ms + self.stimulus_ms + self.recovery_ms


# Reflex features of one eye.
@dataclass(frozen=True)
class KineticSettings:
    nadir_from_ms: float = 100.0
    nadir_to_ms: float = 2500.0
    latency_from_ms: float = 140.0
    latency_to_ms: float = 750.0
    default_latency_ms: float = 220.0
    default_sigma: float = 0.05
    min_points: int = 5
    sluggish_pct: float = 14.0
    sluggish_mcv: float = 1.4
    sluggish_latency_ms: float = 380.0
    fixed_amplitude_mm: float = 0.20
    fixed_pct: float = 5.0
    min_quality: float = 40.0
    reliable_quality: float = 60.0


# Triage thresholds (they differ from the feature thresholds on purpose).
@dataclass(frozen=True)
class TriageSettings:
    severe_anisocoria_mm: float = 1.0
    moderate_anisocoria_mm: float = 0.4
    fixed_pct: float = 5.0
    sluggish_mcv: float = 1.5
    delayed_latency_ms: float = 320.0
    min_quality: float = 40.0
    count_unusable_as_fixed: bool = True


# Live stability, smoothing and retention.
@dataclass(frozen=True)
class LiveSettings:
    stability_window: int = 6
    stability_tolerance_px: float = 0.5
    drops_tolerated: int = 4
    sampling_ms: float = 100.0
    alpha: float = 0.65
    jump_alpha: float = 0.85
    max_jump: float = 0.12
    stats_window: int = 60
    stats_min: int = 5
    latency_window: int = 20
    history: int = 300


# Image audit.
@dataclass(frozen=True)
class AuditSettings:
    width: int = 640
    height: int = 480
    classes: tuple[int, ...] = (0, 1, 2, 3)
    pupil_class: int = 2
    iris_class: int = 3
    tiny_pupil_px: int = 500
    huge_pupil_px: int = 35_000
    low_std: float = 5.0
    hash_bits: int = 64
    hash_distance: int = 2


IRIS_MM = 11.7
