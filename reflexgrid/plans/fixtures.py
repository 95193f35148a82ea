"""Adapters from the provided tables to the recording and image data model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HeatSettings
from ..functions.numeric import half_up, pick
from ..operators.ordered import Heat, Layout
from .recording import Recording

ONSET_MS = 1500.0
OFFSET_MS = 1700.0
TASK_BYTES = 64 << 20  # of enlarged images
TASK_ROWS = 200_000  # frames


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sample_columns(df: DataFrame) -> DataFrame:
    """Frame columns from numbered events (`rn` is the position in the session)."""
    d = lambda c: c.cast("double")
    c = F.col("session_id") % 5
    t = d(F.lit(80) * (F.col("rn") - 1) + F.lit(5) * (F.col("sample_id") % 7)) - F.lit(ONSET_MS)
    bl = F.lit(4.0) + F.lit(0.1) * d(F.col("session_id") % 7)
    br = bl - F.when(c == 3, F.lit(1.2)).otherwise(F.lit(0.05))
    al = pick([(c == 1, F.lit(0.45)), (c == 2, F.lit(0.05))], F.lit(1.4))
    ar = F.when(c == 3, F.lit(0.2)).otherwise(al * F.lit(0.96))
    nz = d((F.col("sample_id") % 11) - 5) * F.lit(0.004) * F.when(c == 4, F.lit(15.0)).otherwise(F.lit(1.0))
    ramp = pick(
        [(t <= 220, F.lit(0.0)), (t <= 1100, (t - F.lit(220.0)) / F.lit(880.0))],
        F.lit(1.0) - F.lit(0.4) * F.least(F.lit(1.0), (t - F.lit(1100.0)) / F.lit(2500.0)),
    )
    lost = F.col("event_type") == "error"
    conf = pick([(lost | (c == 4), F.lit(20.0)), (F.col("event_type") == "signup", F.lit(65.0))], F.lit(95.0))

    def side(base: Column, amp: Column) -> Column:
        return F.when(~lost, half_up(base - amp * ramp + nz, 3))

    rows = df.select(
        "session_id", "sample_id", "ts", "event_type", t.alias("time_ms"), (t + F.lit(ONSET_MS)).alias("frame_ts_ms"),
        side(bl, al).alias("left_mm"), side(br, ar).alias("right_mm"), conf.alias("confidence"),
    )
    status = pick([(F.col("confidence") == 95, F.lit("GOOD")), (F.col("confidence") == 65, F.lit("DEGRADED"))], F.lit("LOST"))
    return rows.select(
        "*", status.alias("status"), (F.col("left_mm") * F.lit(20.0)).alias("left_px"), (F.col("right_mm") * F.lit(20.0)).alias("right_px")
    )


def recording(spark: SparkSession, sf: str, settings: HeatSettings = HeatSettings()) -> Recording:
    """Frame samples read from the event table: one session per user, numbered in event order."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    heat = Heat.measure(events, "user_id", "session_id", settings)
    rows = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("sample_id"), "ts", "event_type")
    tasks = -(-events.count() // TASK_ROWS)
    if tasks > 1:  # the windows of a session follow this one exchange, whose parts would else be merged or grow with the table
        rows = rows.repartition(tasks, "session_id")
    hour = F.date_format("ts", "yyyyMMddHH")
    numbered = heat.apply(rows, ("session_id",), ("ts", "sample_id"), lambda df, lay: lay.number(df, "rn"), hour)
    return Recording(sample_columns(numbered), heat)


def stimuli(samples: DataFrame) -> DataFrame:
    """One stimulus interval per session."""
    return samples.select("session_id").distinct().select(
        "session_id", F.lit(ONSET_MS).alias("onset_ms"), F.lit(OFFSET_MS).alias("offset_ms"),
        F.lit(200.0).alias("configured_ms"), F.lit(200.0).alias("actual_ms"),
    )


# Injury mechanisms and times since injury.
MECHANISMS = (
    "SPORTS_COLLISION", "FALL_ELEVATION", "MOTOR_VEHICLE_ACCIDENT", "BLAST_PRESSURE_WAVE", "BLUNT_ASSAULT",
    "ROUTINE_BASELINE_SCREEN", "OTHER_UNKNOWN",
)
ELAPSED = ("LESS_THAN_30_MIN", "THIRTY_TO_120_MIN", "TWO_TO_SIX_HOURS", "SIX_TO_24_HOURS", "GREATER_THAN_24_HOURS", "NOT_APPLICABLE")
WITHOUT_REPORT = 1_000_000


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Patient context per user, plus one user in ten again under an id without any recording."""
    ids = table(spark, sf, "events").select("user_id").distinct()
    shifted = ids.where(F.col("user_id") % 10 == 0).select((F.col("user_id") + WITHOUT_REPORT).alias("user_id"))
    u = F.col("user_id")
    symptoms = pick(
        [
            (u % 6 == 1, F.array(F.lit("DIZZINESS_VERTIGO"))),
            (u % 6 == 3, F.array(F.lit("REPEATED_VOMITING"), F.lit("SEIZURE_CONVULSION"))),
            (u % 6 == 5, F.array(F.lit("NECK_PAIN_SPINAL_TENDERNESS"))),
        ],
        F.array().cast("array<string>"),
    )
    pick_one = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    return ids.unionByName(shifted).select(
        u.alias("session_id"), F.concat(F.lit("P-"), u.cast("string")).alias("patient_id"), (u % 80 + 10).cast("int").alias("age_years"),
        pick_one(MECHANISMS, u % 7).alias("mechanism"), pick_one(ELAPSED, u % 6).alias("time_elapsed"),
        symptoms.alias("symptoms"), (u % 10 == 3).alias("known_anisocoria"),
    )


def method_b(samples: DataFrame) -> DataFrame:
    """A second measurement of the same frames: shifted, partly stale, partly missing."""
    e = F.col("sample_id")
    shift = ((e % 5) - 2).cast("double") * F.lit(0.5)
    gone = e % 13 == 0
    side = lambda px: F.when(~gone, F.col(px) + shift)
    return samples.select(
        "session_id", "sample_id", (F.col("frame_ts_ms") + F.when(e % 9 == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("ts_ms"),
        side("left_px").alias("left_px_b"), side("right_px").alias("right_px_b"),
        (F.lit(320) + e % 4).cast("double").alias("center_x_b"), (F.lit(240) + e % 3).cast("double").alias("center_y_b"),
    )


def thumb_vectors(spark: SparkSession, sf: str, exact_copies: bool = True) -> DataFrame:
    """8x8 images (split, sample, subject, v) from the embedding vectors, with near and exact copies in the val split."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("subject"), F.col("embedding").alias("v"))
    own = e.select(F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("vec_id").alias("sample"), "subject", "v")
    flipped = F.transform("v", lambda x, i: F.when(i == F.col("vec_id") % 64, -x).otherwise(x))
    near = e.where(F.col("vec_id") % 25 == 1).select(F.lit("val").alias("split"), (F.col("vec_id") + 1_000_000).alias("sample"), "subject", flipped.alias("v"))
    rows = own.unionByName(near)
    if exact_copies:
        rows = rows.unionByName(
            e.where(F.col("vec_id") % 25 == 6).select(F.lit("val").alias("split"), (F.col("vec_id") + 2_000_000).alias("sample"), "subject", "v")
        )
    return rows


def thumbs(spark: SparkSession, sf: str, exact_copies: bool = True) -> DataFrame:
    """The 8x8 images as pixel tables."""
    rows = thumb_vectors(spark, sf, exact_copies)
    return rows.select("split", "sample", "subject", F.posexplode("v").alias("i", "val")).select(
        "split", "sample", "subject", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"),
        F.floor(F.col("val").cast("double") * F.lit(1000.0) + F.lit(0.5)).cast("double").alias("lum"),
    )


def thumb_images(spark: SparkSession, sf: str, zoom: tuple[int, int] = (1, 1)) -> DataFrame:
    """The 8x8 images as binary rows (split, sample, height, width, lum, cls), each pixel's class enlarged to `zoom` (lines, columns); `lum` stays 8x8.

    Vectors are dealt to as many tasks as image files of that size would be read by, since Arrow hands on thousands of rows at a time."""
    high, wide = zoom

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 8, 8)
                lum = np.floor(v * 1000.0 + 0.5)
                cls = np.select([lum > 20.0, lum > -50.0, lum > -120.0], [2, 3, 1], 0).astype(np.uint8)
                big = [i.repeat(high, 0).repeat(wide, 1).tobytes() for i in cls]
                n = part.num_rows
                yield pa.record_batch(
                    [part.column("split"), part.column("sample"), pa.array([8 * high] * n, pa.int32()), pa.array([8 * wide] * n, pa.int32()), pa.array([i.tobytes() for i in lum], pa.binary()), pa.array(big, pa.binary())],
                    names=["split", "sample", "height", "width", "lum", "cls"],
                )

    vectors = thumb_vectors(spark, sf).select("split", "sample", "v")
    tasks = -(-vectors.count() * 64 * high * wide // TASK_BYTES) if high * wide > 1 else 1
    if tasks > 1:
        vectors = vectors.repartition(tasks, "split", "sample")
    return vectors.mapInArrow(run, "split string, sample long, height int, width int, lum binary, cls binary")


def class_of(lum: Column, shift: float = 0.0) -> Column:
    return pick(
        [(lum > 20.0 + shift, F.lit(2)), (lum > -50.0 + shift, F.lit(3)), (lum > -120.0 + shift, F.lit(1))],
        F.lit(0),
    )


def masks(thumb: DataFrame, shift: float = 0.0) -> DataFrame:
    return thumb.select("split", "sample", "y", "x", class_of(F.col("lum"), shift).alias("class"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Four class scores for 4x4 pixels per vector, in long form."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    p = F.floor(F.col("i") / 4)
    return e.select(
        F.col("vec_id").alias("sample"), F.floor(p / 4).cast("int").alias("y"), (p % 4).cast("int").alias("x"),
        (F.col("i") % 4).cast("int").alias("class"), F.col("v").cast("double").alias("logit"),
    )


def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """478 points per vector (468, i.e. no iris, for one vector in eleven)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = F.when(F.col("vec_id") % 11 == 0, F.lit(468)).otherwise(F.lit(478))
    point = lambda i: F.struct(
        ((F.get("v", i % 64) + F.lit(1.0)) / F.lit(2.0)).alias("x"),
        ((F.get("v", (i * 7) % 64) + F.lit(1.0)) / F.lit(2.0)).alias("y"),
        F.lit(0.0).alias("z"),
    )
    return e.select(F.col("vec_id").alias("sample"), F.transform(F.sequence(F.lit(0), n - 1), point).alias("lm"))
