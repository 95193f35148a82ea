"""Reports as JSON, text, table rows and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SESSION_CSV

META = (("application", "Quantitative pupillometry on Spark"), ("standard", "Corneal iris-ratio calibrated (11.7mm human iris reference)"), ("version", "1.0.0"))


def clinical_json(assessed: DataFrame) -> DataFrame:
    """One JSON document {meta, patient, triage, plrReport} per session with a report."""
    eye = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("baseline_mm", "min_mm", "amplitude_mm", "constriction_pct", "latency_ms", "mcv_mm_s", "recovery75_ms", "quality_score", "response_pattern")])
    doc = F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in META]).alias("meta"),
        F.struct("patient_id", "age_years", "mechanism", "time_elapsed", "symptoms", "known_anisocoria").alias("patient"),
        F.struct("urgency", "headline", "summary", "triggers", "directives", "needs_transport", "needs_suspension").alias("triage"),
        F.struct(eye("left").alias("left_eye"), eye("right").alias("right_eye"), "baseline_anisocoria_mm", "asymmetry_severity", "is_reliable", "overall_quality", "notes").alias("plrReport"),
    )
    return assessed.where("has_report").select("session_id", F.to_json(doc).alias("json"))


def handoff_text(assessed: DataFrame) -> DataFrame:
    """Plain-text handoff per session with a report."""
    c = F.col
    name = F.when(c("patient_id") == "", F.lit("N/A")).otherwise(F.coalesce("patient_id", F.lit("N/A")))
    age = F.coalesce(F.nullif(c("age_years"), F.lit(0)).cast("string"), F.lit("N/A"))
    lines: list[Column] = [
        F.lit("=== CLINICAL PUPILLOMETRY REPORT ==="),
        F.format_string("Patient ID: %s (Age: %s)", name, age),
        F.format_string("Mechanism: %s | Time: %s", c("mechanism"), c("time_elapsed")),
        F.format_string("Triage Status: %s (%s)", c("headline"), c("urgency")),
        F.lit(""),
        F.lit("[BILATERAL PLR KINETICS]"),
        F.format_string("- Baseline (D_base): OS (Left) %.2f mm | OD (Right) %.2f mm", c("left_baseline_mm"), c("right_baseline_mm")),
        F.format_string("- Constriction Nadir: OS %.2f mm | OD %.2f mm", c("left_min_mm"), c("right_min_mm")),
        F.format_string(
            "- Amplitude: OS %.2f mm (%.1f%%) | OD %.2f mm (%.1f%%)", c("left_amplitude_mm"), c("left_constriction_pct"), c("right_amplitude_mm"), c("right_constriction_pct")
        ),
        F.format_string("- Latency: OS %.0f ms | OD %.0f ms (Δ %.0f ms)", c("left_latency_ms"), c("right_latency_ms"), c("latency_diff_ms")),
        F.format_string("- Max Constriction Velocity (MCV): OS %.2f mm/s | OD %.2f mm/s", c("left_mcv_mm_s"), c("right_mcv_mm_s")),
        F.format_string("- Baseline Anisocoria: %.2f mm (%s)", c("baseline_anisocoria_mm"), c("asymmetry_severity")),
        F.lit(""),
        F.lit("[TRIAGE DIRECTIVES]"),
        F.array_join(F.transform("directives", lambda d: F.concat(F.lit("* "), d)), "\n"),
    ]
    return assessed.where("has_report").select("session_id", F.concat_ws("\n", *lines).alias("text"))


def table_rows(stats: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """Markdown table rows, one per input row."""
    cells = [F.concat(F.lit("**"), F.col(title).cast("string"), F.lit("**")), *[F.col(c).cast("string") for c in columns]]
    return stats.select(title, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def audit_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


# Verdicts and match types of the audit report.
READY, NOT_READY = "READY FOR PREPROCESSING", "NOT READY"
EXACT, NEAR = "PERCEPTUAL_EXACT", "PERCEPTUAL_NEAR"
REPORT = "split string, pairs struct<original:long,clean:long,corrupted:long,invalid_masks:long>, class_distribution array<struct<class:int,pixels:long,percent:double>>, pupil_area struct<samples:long,min_px:double,max_px:double,mean_px:double,median_px:double,p5:double,p95:double>, leakage_pairs long, status string"


def audit_report(summary: DataFrame, classes: DataFrame, areas: DataFrame, leaks: DataFrame, path: str) -> None:
    """The audit as JSON, one document per split: counts of pairs, class distribution, pupil areas, leakage and the verdict. Lists that grow with the
    data (leaking pairs, flagged samples) are tables of their own, see `leak_rows`."""
    counts = F.struct(F.col("pairs").alias("original"), F.col("valid").alias("clean"), "corrupted", (F.col("bad_mask_size") + F.col("bad_channels") + F.col("bad_values")).alias("invalid_masks"))
    shares = classes.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("class", "pixels", "percent"))).alias("class_distribution"))  # a few classes
    sizes = areas.groupBy("split").agg(
        F.struct(
            F.count(F.lit(1)).alias("samples"), F.min("area").cast("double").alias("min_px"), F.max("area").cast("double").alias("max_px"), F.avg("area").alias("mean_px"),
            F.percentile("area", 0.5).alias("median_px"), F.percentile("area", 0.05).alias("p5"), F.percentile("area", 0.95).alias("p95"),
        ).alias("pupil_area")
    )
    total = leaks.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("leakage_pairs"))
    # one line per split, and one number
    rows = summary.select("split", counts.alias("pairs")).join(shares, "split", "left").join(sizes, "split", "left").crossJoin(F.broadcast(total))
    ready = (F.col("pairs.clean") > 0) & (F.col("pairs.corrupted") == 0)
    rows.withColumn("status", F.when(ready, READY).otherwise(NOT_READY)).coalesce(1).write.mode("overwrite").json(path)


def leak_rows(pairs: DataFrame) -> DataFrame:
    """A markdown row per leaking pair (val_sample, train_sample, distance, similarity)."""
    kind = F.when(F.col("distance") == 0, EXACT).otherwise(NEAR)
    line = F.format_string("| `%s` | `%s` | `%s` | %.1f%% (Hamming=%d) |", F.col("val_sample").cast("string"), F.col("train_sample").cast("string"), kind, F.col("similarity") * 100, "distance")
    return pairs.select("val_sample", "train_sample", line.alias("line"))


def percentile_rows(percentiles: DataFrame, columns: list[str]) -> DataFrame:
    """A markdown row per split and percentile."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c.upper()).alias("name"), F.col(c).alias("value")) for c in columns])).alias("p")
    rows = percentiles.select("split", pairs)
    return rows.select("split", F.col("p.name").alias("name"), F.format_string("| **%s** | %s | %.2f px |", "p.name", "split", "p.value").alias("line"))


def read_session_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_CSV).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
