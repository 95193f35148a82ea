"""Column functions on recorded frames: calibration, validity, phase, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IRIS_MM, ProtocolSettings, RepairSettings
from .numeric import clamp, half_up, is_finite, pick


def iris_radius_px(radius_norm: Column, frame_width: float = 1280.0) -> Column:
    return radius_norm * F.lit(frame_width)


def px_to_mm(mm: Column, px: Column, iris_px: Column, detected: Column) -> Column:
    """Measured mm if given, else scaled by the iris, else by a flat factor; 3 digits, zero is missing."""
    usable = detected & (F.coalesce(px, F.lit(0.0)) != 0)
    scaled = F.when(iris_px > 5, px / (F.lit(2.0) * iris_px) * F.lit(IRIS_MM)).otherwise(px * F.lit(0.1))
    value = F.coalesce(mm, F.when(usable, scaled))
    return F.nullif(half_up(value, 3), F.lit(0.0))


def status_confidence(status: Column) -> Column:
    return pick([(status == "GOOD", F.lit(95.0)), (status == "DEGRADED", F.lit(65.0))], F.lit(20.0))


def is_blink(left_detected: Column, right_detected: Column, left_eye: Column, right_eye: Column) -> Column:
    return ~left_detected & ~right_detected & (~left_eye | ~right_eye)


def frame_to_sample(frame: Column, onset_ms: Column, frame_width: float = 1280.0) -> list[Column]:
    """Sample columns of a nested frame: time from onset, size, iris radius and millimetres of both eyes, status, confidence, blink.

    `frame` has timestamp, pupilData.{left,right}Pupil (detected, diameterPx, diameterMm, status), ocularData.{left,right}Eye (boolean),
    ocularData.{left,right}IrisRadiusNorm and tracking.status. The status is that of the left pupil.
    """
    pupil = {side: frame["pupilData"][f"{side}Pupil"] for side in ("left", "right")}
    eye = {side: F.coalesce(frame["ocularData"][f"{side}Eye"], F.lit(False)) for side in pupil}
    iris = {side: iris_radius_px(frame["ocularData"][f"{side}IrisRadiusNorm"], frame_width) for side in pupil}
    out = [half_up(relative_time(frame["timestamp"], onset_ms)).alias("rel_ms")]
    for side, p in pupil.items():
        out += [
            F.when(p["detected"], p["diameterPx"]).alias(f"{side}_px"), iris[side].alias(f"{side}_iris_px"),
            px_to_mm(p["diameterMm"], p["diameterPx"], iris[side], p["detected"]).alias(f"{side}_mm"),
        ]
    return [
        *out, pupil["left"]["status"].alias("tracking_status"), status_confidence(frame["tracking"]["status"]).alias("tracking_confidence"),
        is_blink(pupil["left"]["detected"], pupil["right"]["detected"], eye["left"], eye["right"]).alias("is_blink"),
    ]


def is_usable(mm: Column, confidence: Column, cfg: RepairSettings = RepairSettings()) -> Column:
    """Physiologically possible diameter with enough confidence."""
    ok = is_finite(mm) & (mm >= cfg.min_mm) & (mm <= cfg.max_mm) & (confidence >= cfg.min_confidence)
    return F.coalesce(ok, F.lit(False))


def is_bilateral(left_px: Column, right_px: Column, left_status: Column, right_status: Column) -> Column:
    """Both pupils found with a finite positive size."""
    found = ("DETECTED", "UNCERTAIN")

    def side(px: Column, status: Column) -> Column:
        return status.isin(*found) & is_finite(px) & (px > 0)

    return F.coalesce(side(left_px, left_status) & side(right_px, right_status), F.lit(False))


def relative_time(ts_ms: Column, onset_ms: Column) -> Column:
    return ts_ms - onset_ms


def phase(elapsed_ms: Column, cfg: ProtocolSettings = ProtocolSettings()) -> Column:
    return pick(
        [
            (elapsed_ms < cfg.baseline_ms, F.lit("BASELINE")),
            (elapsed_ms < cfg.baseline_ms + cfg.stimulus_ms, F.lit("STIMULUS")),
            (elapsed_ms < cfg.total_ms, F.lit("CONSTRICTION_RECOVERY")),
        ],
        F.lit("PROCESSING"),
    )


def progress(elapsed_ms: Column, cfg: ProtocolSettings = ProtocolSettings()) -> Column:
    return F.least(F.lit(100.0), half_up(elapsed_ms / F.lit(cfg.total_ms) * F.lit(100.0)))


def session_label(day: Column, key: Column) -> Column:
    """OP-YYYYMMDD-XXXX with a stable suffix taken from the key."""
    return F.concat(F.lit("OP-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 4)))


def anisocoria_gauge(left_mm: Column, right_mm: Column) -> tuple[Column, Column]:
    """(is normal, marker offset in percent); zero counts as missing."""
    seen = (F.coalesce(left_mm, F.lit(0.0)) != 0) & (F.coalesce(right_mm, F.lit(0.0)) != 0)
    normal = F.when(seen, F.abs(left_mm - right_mm) < 0.4).otherwise(F.lit(True))
    offset = F.when(seen, clamp(F.lit(50.0) + (left_mm - right_mm) * F.lit(40.0), 10.0, 90.0)).otherwise(F.lit(51.0))
    return normal, offset


def confidence_tier(score: Column) -> Column:
    return pick(
        [(score >= 95, F.lit("Excellent")), (score >= 80, F.lit("Good")), (score >= 60, F.lit("Unstable"))],
        F.lit("Recalibration"),
    )


def quality_tier(score: Column) -> Column:
    return pick([(score >= 80, F.lit("HIGH")), (score >= 60, F.lit("MEDIUM"))], F.lit("LOW"))
