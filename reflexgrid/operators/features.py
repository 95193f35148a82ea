"""Feature vector per session for later models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Heat, Layout


def centre_jitter(points: DataFrame, heat: Heat) -> DataFrame:
    """Deviation of the step lengths of the pupil centre (session_id, frame_ts_ms, sample_id, x, y)."""

    def steps(df: DataFrame, layout: Layout) -> DataFrame:
        w = layout.window()
        rows = layout.extend(df, 1, 0)
        dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
        return layout.trim(rows.withColumn("step", F.sqrt(dx * dx + dy * dy))).select("session_id", "step")

    return heat.apply(points, ("session_id",), ("frame_ts_ms", "sample_id"), steps).groupBy("session_id").agg(F.stddev_pop("step").alias("landmark_jitter"))


def feature_vector(asym: DataFrame, samples: DataFrame, jitter: DataFrame, brightness: DataFrame) -> DataFrame:
    """The 18 features of a session."""
    missing = samples.groupBy("session_id").agg((F.count_if(F.col("left_mm").isNull() | F.col("right_mm").isNull()) / F.count(F.lit(1))).alias("missing_frame_ratio"))
    two = lambda name, col: [F.col(f"{s}_{col}").alias(f"{name}_{s}") for s in ("left", "right")]
    return asym.join(missing, "session_id").join(jitter, "session_id").join(brightness, "session_id").select(
        "session_id", *two("baseline", "baseline_mm"), *two("min", "min_mm"), *two("amplitude", "amplitude_mm"), *two("constriction_pct", "constriction_pct"),
        *two("latency", "latency_ms"), *two("mcv", "mcv_mm_s"), *two("recovery_time", "recovery75_ms"), F.col("baseline_anisocoria_mm").alias("asymmetry"),
        "missing_frame_ratio", "landmark_jitter", "brightness",
    )
