"""The session pipeline: samples to clean series, metrics, asymmetry and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kinetics, signal
from ..operators.ordered import Heat

EYE_KEYS = ("session_id", "eye")
EYE_ORDER = ("time_ms", "sample_id")


@dataclass(frozen=True)
class Recording:
    """Frame samples, their stimulus-relative time and the sessions too large for one task."""

    samples: DataFrame
    heat: Heat

    def long(self) -> DataFrame:
        return signal.eyes_long(self.samples)

    def per_eye(self, fn, df: DataFrame | None = None) -> DataFrame:
        return self.heat.apply(df if df is not None else self.long(), EYE_KEYS, EYE_ORDER, fn)

    def clean(self) -> DataFrame:
        return self.per_eye(signal.clean_series)

    def features(self) -> DataFrame:
        return self.per_eye(lambda df, lay: kinetics.eye_features(signal.clean_series(df, lay), lay))

    def eye_keys(self) -> DataFrame:
        sides = F.explode(F.array(F.lit("L"), F.lit("R"))).alias("eye")
        return self.samples.select("session_id").distinct().select("session_id", sides)

    def metrics(self) -> DataFrame:
        return kinetics.eye_metrics(self.eye_keys(), self.features(), kinetics.baseline_px(self.samples))

    def asymmetry(self) -> DataFrame:
        return kinetics.asymmetry(kinetics.pair_eyes(self.metrics()))

    def summary(self) -> DataFrame:
        kept = self.per_eye(signal.repair_gaps).groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"))
        return kinetics.session_summary(self.samples, kept)

    def report(self) -> DataFrame:
        """The series are computed once: the summary takes its point counts from the metrics."""
        rows = self.asymmetry().join(kinetics.frame_totals(self.samples), "session_id")
        return kinetics.report(kinetics.with_summary(rows, F.col("left_kept_points") + F.col("right_kept_points")))
