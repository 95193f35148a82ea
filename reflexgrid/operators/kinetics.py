"""Reflex features per eye, left/right asymmetry and the session report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KineticSettings, ProtocolSettings
from ..functions.numeric import clamp, half_up, or_else, pick, settle
from .ordered import Layout


def frame_totals(samples: DataFrame) -> DataFrame:
    """Frame count, duration and mean confidence of each session."""
    return samples.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), (F.max("frame_ts_ms") - F.min("frame_ts_ms")).alias("duration_ms"), F.avg("confidence").alias("_conf")
    )


def with_summary(totals: DataFrame, kept: Column) -> DataFrame:
    """Add frame rate, usable share and recording quality; `kept` counts the usable points of both eyes."""
    ratio = F.coalesce(kept, F.lit(0)) / (F.col("frames") * F.lit(2))
    fps = F.when(F.col("duration_ms") > 0, half_up(F.col("frames") * F.lit(1000.0) / F.col("duration_ms"))).otherwise(F.lit(0.0))
    return totals.select(
        "*", fps.alias("average_fps"), settle(ratio, 4).alias("valid_ratio"), settle(F.col("_conf"), 2).alias("mean_confidence"),
        settle(clamp(ratio * F.lit(50.0) + F.col("_conf") * F.lit(0.5), 0.0, 100.0), 0).alias("recording_quality"),
    ).drop("_conf")


def session_summary(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Duration, frame rate, usable share and recording quality; `kept` is (session_id, kept)."""
    return with_summary(frame_totals(samples).join(kept, "session_id", "left"), F.col("kept")).drop("kept")


def baseline_px(samples: DataFrame) -> DataFrame:
    """Last non-zero pixel size of each eye before the stimulus."""
    early = samples.where(F.col("time_ms") < 0)
    rank = F.struct("frame_ts_ms", "sample_id")

    def last(px: str) -> Column:
        return F.max_by(px, F.when(F.coalesce(F.col(px), F.lit(0.0)) != 0, rank))

    wide = early.groupBy("session_id").agg(last("left_px").alias("l"), last("right_px").alias("r"))
    return wide.select(
        "session_id",
        F.explode(F.array(F.struct(F.lit("L").alias("eye"), F.col("l").alias("base_px")), F.struct(F.lit("R").alias("eye"), F.col("r").alias("base_px")))).alias("e"),
    ).select("session_id", "e.eye", "e.base_px")


def series_stats(clean: DataFrame, layout: Layout, cfg: KineticSettings = KineticSettings()) -> DataFrame:
    """Attach baseline, noise and nadir of the series to each of its rows."""
    t, v = F.col("time_ms"), F.col("clean_mm")
    base = F.when(t <= 0, v)
    low = F.struct(v.alias("v"), F.col("idx").alias("i"), t.alias("t"))
    rows = layout.totals(
        clean,
        {
            "_n": F.count(F.lit(1)),
            "_avg": F.avg(base),
            "_std": F.stddev_pop(base),
            "_first": F.min(F.when(F.col("idx") == 1, v)),
            "_conf": F.avg("confidence"),
            "_near": F.min(F.when((t >= cfg.nadir_from_ms) & (t <= cfg.nadir_to_ms), low)),
            "_any": F.min(F.when(t > 0, low)),
        },
    )
    rows = rows.withColumn("baseline", half_up(F.coalesce("_avg", "_first"), 9)).withColumn(
        "sigma", half_up(F.coalesce(F.col("_std"), F.lit(cfg.default_sigma)), 9)
    )
    nadir = F.when(F.col("_near.v") < F.col("baseline"), F.col("_near")).when(F.col("_any.v") < F.col("baseline"), F.col("_any"))
    return rows.withColumn("_nadir", nadir).select(
        *clean.columns, "baseline", "sigma",
        F.col("_n").alias("points"), F.col("_conf").alias("mean_conf"),
        F.coalesce("_nadir.v", "baseline").alias("nadir"), F.col("_nadir.i").alias("nadir_idx"), F.col("_nadir.t").alias("nadir_ms"),
        F.greatest(F.lit(0.0), F.col("baseline") - F.coalesce("_nadir.v", "baseline")).alias("amplitude"),
    )


def eye_features(clean: DataFrame, layout: Layout, cfg: KineticSettings = KineticSettings()) -> DataFrame:
    """Raw features per (session, eye): one window pass for the totals, one aggregate on the same key."""
    t, v, vel = F.col("time_ms"), F.col("clean_mm"), F.col("velocity")
    sigma, base, amp = F.col("sigma"), F.col("baseline"), F.col("amplitude")
    speed_limit = F.least(F.lit(-0.18), F.lit(-2.0) * F.greatest(F.lit(0.04), sigma * F.lit(5.0)))
    drop_limit = F.greatest(F.lit(0.04), sigma * F.lit(1.5))
    moved = (t >= cfg.latency_from_ms) & (t <= cfg.latency_to_ms) & (vel <= speed_limit) & (v <= base - drop_limit)
    falling = (t >= cfg.nadir_from_ms) & (vel < 0) & (F.col("nadir_idx").isNull() | (F.col("idx") <= F.col("nadir_idx") + 2))
    back = (amp >= 0.3) & (F.col("idx") >= F.col("nadir_idx")) & (v >= F.col("nadir") + amp * F.lit(0.75))
    peak = F.struct((-vel).alias("speed"), (-F.col("idx")).alias("i"), t.alias("t"), v.alias("v"))
    rows = series_stats(clean, layout, cfg)
    same = ["baseline", "sigma", "points", "mean_conf", "nadir", "nadir_ms", "amplitude"]
    grouped = rows.groupBy("session_id", "eye").agg(
        *[F.first(c).alias(c) for c in same],
        F.min(F.when(moved, t)).alias("_moved"),
        F.max(F.when(falling, peak)).alias("_peak"),
        F.min(F.when(back, F.struct(F.col("idx").alias("i"), t.alias("t")))).alias("_back"),
    )
    speed = F.coalesce(F.col("_peak.speed"), F.lit(0.0))
    start = half_up(F.coalesce(F.col("_moved"), F.lit(cfg.default_latency_ms)))
    cross = half_up(F.col("_peak.t") - (F.col("_peak.v") - base) / F.nullif(-F.col("_peak.speed"), F.lit(0.0)), 9)
    tangent = (speed >= 1.0) & (amp >= 0.3) & cross.between(150.0, 600.0)
    latency = F.when(F.coalesce(tangent, F.lit(False)), half_up(F.when(F.col("_moved").isNotNull(), F.least(start, cross)).otherwise(cross))).otherwise(start)
    return grouped.select(
        "session_id", "eye", *same, speed.alias("peak_speed"), latency.alias("latency_ms"),
        (F.col("_back.t") - F.col("nadir_ms")).alias("recovery_ms"),
    )


def eye_metrics(keys: DataFrame, features: DataFrame, px: DataFrame, cfg: KineticSettings = KineticSettings()) -> DataFrame:
    """Published metrics for every (session, eye) in `keys`; unusable series give an inconclusive zero row."""
    rows = keys.join(features, ["session_id", "eye"], "left").join(px, ["session_id", "eye"], "left")
    enough = F.coalesce(F.col("points"), F.lit(0)) >= cfg.min_points
    amp, base = F.col("amplitude"), F.col("baseline")
    pct = F.when(base > 0, amp / base * F.lit(100.0)).otherwise(F.lit(0.0))
    rows = rows.withColumn("pct", half_up(pct, 9)).withColumn("mcv", settle(F.col("peak_speed"), 2))
    to_min = F.greatest(F.lit(0.0), F.coalesce(F.col("nadir_ms"), F.lit(0.0)))
    seconds = F.greatest(F.lit(0.05), (to_min - F.col("latency_ms")) / F.lit(1000.0))
    snr = clamp(half_up(F.lit(100.0) - F.col("sigma") * F.lit(200.0)), 0.0, 100.0)
    rows = rows.withColumn("quality", settle(F.col("mean_conf") * F.lit(0.6) + snr * F.lit(0.4), 0))
    pattern = pick(
        [
            (F.col("quality") < cfg.min_quality, F.lit("INCONCLUSIVE")),
            ((amp < cfg.fixed_amplitude_mm) | (F.col("pct") < cfg.fixed_pct), F.lit("NON_REACTIVE_FIXED")),
            ((F.col("pct") < cfg.sluggish_pct) | (F.col("mcv") < cfg.sluggish_mcv) | (F.col("latency_ms") > cfg.sluggish_latency_ms), F.lit("SLUGGISH_REDUCED")),
        ],
        F.lit("NORMAL_REACTIVE"),
    )
    base_px = or_else(F.col("base_px"), base * F.lit(20.0))
    none = F.lit(0.0)

    def usable(value: Column, empty: Column = none) -> Column:
        return F.when(enough, value).otherwise(empty)

    return rows.select(
        "session_id", "eye",
        usable(settle(base, 2)).alias("baseline_mm"),
        usable(settle(base_px, 1), F.coalesce(F.col("base_px"), none)).alias("baseline_px"),
        usable(settle(F.col("nadir"), 2)).alias("min_mm"),
        usable(settle(base_px * (F.lit(1.0) - F.col("pct") / F.lit(100.0)), 1)).alias("min_px"),
        usable(settle(amp, 2)).alias("amplitude_mm"),
        usable(settle(F.col("pct"), 1)).alias("constriction_pct"),
        usable(F.col("latency_ms")).alias("latency_ms"),
        usable(F.col("mcv")).alias("mcv_mm_s"),
        usable(half_up(to_min)).alias("time_to_min_ms"),
        usable(settle(amp / seconds, 2)).alias("mean_velocity_mm_s"),
        F.when(enough, half_up(F.col("recovery_ms"))).alias("recovery75_ms"),
        usable(F.col("quality")).alias("quality_score"),
        usable(pattern, F.lit("INCONCLUSIVE")).alias("response_pattern"),
        F.coalesce(F.col("points"), F.lit(0)).alias("kept_points"),
    )


EYE_COLUMNS = (
    "baseline_mm", "baseline_px", "min_mm", "min_px", "amplitude_mm", "constriction_pct", "latency_ms", "mcv_mm_s",
    "time_to_min_ms", "mean_velocity_mm_s", "recovery75_ms", "quality_score", "response_pattern", "kept_points",
)


def pair_eyes(metrics: DataFrame) -> DataFrame:
    """One row per session with left_* and right_* columns."""
    sides = [("L", "left"), ("R", "right")]
    return metrics.groupBy("session_id").agg(
        *[F.max(F.when(F.col("eye") == e, F.col(c))).alias(f"{side}_{c}") for e, side in sides for c in EYE_COLUMNS]
    )


def asymmetry(pairs: DataFrame) -> DataFrame:
    """Left/right differences of the published (rounded) metrics and their severity."""

    def gap(name: str, digits: int) -> Column:
        return settle(F.abs(F.col(f"left_{name}") - F.col(f"right_{name}")), digits)

    rows = pairs.select(
        "*",
        gap("baseline_mm", 2).alias("baseline_anisocoria_mm"), gap("min_mm", 2).alias("min_anisocoria_mm"),
        gap("constriction_pct", 1).alias("constriction_pct_diff"), gap("amplitude_mm", 2).alias("amplitude_diff_mm"),
        gap("latency_ms", 0).alias("latency_diff_ms"), gap("mcv_mm_s", 2).alias("mcv_diff_mm_s"),
    )
    ani, pct, lat = F.col("baseline_anisocoria_mm"), F.col("constriction_pct_diff"), F.col("latency_diff_ms")
    severity = pick(
        [
            ((ani >= 1.0) | (pct >= 16.0) | (lat > 120), F.lit("MARKED_ASYMMETRY")),
            ((ani >= 0.4) | (pct >= 8.0) | (lat > 60), F.lit("MILD_ASYMMETRY")),
        ],
        F.lit("SYMMETRIC"),
    )
    return rows.withColumn("asymmetry_severity", severity).withColumn("is_asymmetric", F.col("asymmetry_severity") != "SYMMETRIC")


def report(rows: DataFrame, cfg: KineticSettings = KineticSettings()) -> DataFrame:
    """Overall quality, reliability and notes (array of text) per session, from asymmetry and summary columns."""
    overall = half_up((F.col("left_quality_score") + F.col("right_quality_score") + F.col("recording_quality")) / F.lit(3.0))
    rows = rows.withColumn("overall_quality", overall)
    left, right = F.col("left_response_pattern"), F.col("right_response_pattern")
    reliable = (F.col("overall_quality") >= cfg.reliable_quality) & (left != "INCONCLUSIVE") & (right != "INCONCLUSIVE")
    rows = rows.withColumn("is_reliable", reliable)
    severity = F.regexp_replace("asymmetry_severity", "^([^_]*)_", "$1 ")
    asym_note = F.format_string(
        "Significant bilateral asymmetry detected (%s): ΔConstriction = %.1f%%, Anisocoria = %.2f mm.",
        severity, F.col("constriction_pct_diff"), F.col("baseline_anisocoria_mm"),
    )
    notes = [
        F.when(~F.col("is_reliable"), F.lit("Recording quality below physiological threshold; result marked INCONCLUSIVE.")),
        F.when(F.col("is_asymmetric"), asym_note),
        F.when(left == "NON_REACTIVE_FIXED", F.lit("Left pupil non-reactive / fixed under light stimulus.")),
        F.when(right == "NON_REACTIVE_FIXED", F.lit("Right pupil non-reactive / fixed under light stimulus.")),
        F.when(left == "SLUGGISH_REDUCED", F.lit("Left pupil exhibited sluggish / reduced constriction velocity.")),
        F.when(right == "SLUGGISH_REDUCED", F.lit("Right pupil exhibited sluggish / reduced constriction velocity.")),
    ]
    return rows.withColumn("notes", F.array_compact(F.array(*notes)))
