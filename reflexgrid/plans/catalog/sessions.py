"""Queries on recorded sessions: validity, cleaning, features, asymmetry, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import samples as fs
from ...functions.numeric import half_up, settle
from ...operators import signal
from .. import fixtures as fx
from .registry import add
from .sql import EDGE, FIVE, SHORT, case, query, r, s, slope_sql


def _samples(spark, sf) -> DataFrame:
    return fx.recording(spark, sf).samples


# ---- projections and predicates -----------------------------------------------------------------
def sample_validity(spark, sf):
    b = fs.is_bilateral(F.col("left_px"), F.col("right_px"), *[F.when(F.col("left_mm").isNull(), "LOST").otherwise("DETECTED")] * 2)
    return _samples(spark, sf).select(
        "session_id", "sample_id", fs.is_usable(F.col("left_mm"), F.col("confidence")).alias("left_valid"),
        fs.is_usable(F.col("right_mm"), F.col("confidence")).alias("right_valid"), b.alias("bilateral_valid"),
    )


add(
    "sample_validity",
    sample_validity,
    query(
        ("samples",),
        """SELECT session_id, sample_id, coalesce(left_mm BETWEEN 1 AND 95e-1 AND confidence >= 20, false) AS left_valid,
           coalesce(right_mm BETWEEN 1 AND 95e-1 AND confidence >= 20, false) AS right_valid, left_px IS NOT NULL AND right_px IS NOT NULL AS bilateral_valid FROM samples""",
    ),
)
add(
    "status_confidence",
    lambda spark, sf: _samples(spark, sf).groupBy("status", fs.status_confidence(F.col("status")).alias("conf")).agg(F.count(F.lit(1)).alias("n")),
    query(("samples",), f"SELECT status, {case([("status = 'GOOD'", '95e0'), ("status = 'DEGRADED'", '65e0')], '20e0')} AS conf, count(*) AS n FROM samples GROUP BY ALL"),
)
add(
    "phase_label",
    lambda spark, sf: _samples(spark, sf).select(
        "session_id", "sample_id", fs.relative_time(F.col("frame_ts_ms"), F.lit(fx.ONSET_MS)).alias("rel_ms"),
        fs.phase(F.col("frame_ts_ms")).alias("phase"), fs.progress(F.col("frame_ts_ms")).alias("progress_pct"),
    ),
    query(
        ("samples",),
        f"""SELECT session_id, sample_id, frame_ts_ms - 1500e0 AS rel_ms, CASE WHEN frame_ts_ms < 1500 THEN 'BASELINE' WHEN frame_ts_ms < 1700 THEN 'STIMULUS'
            WHEN frame_ts_ms < 5200 THEN 'CONSTRICTION_RECOVERY' ELSE 'PROCESSING' END AS phase, least(100e0, {r('frame_ts_ms / 5200e0 * 100e0')}) AS progress_pct FROM samples""",
    ),
)


def px_to_mm(spark, sf):
    e = F.col("sample_id")
    iris = F.when(e % 4 == 0, F.lit(0.003)).otherwise((e % 9).cast("double") * F.lit(0.01))
    mm = F.when(e % 5 == 0, F.col("left_mm"))
    radius = fs.iris_radius_px(iris)
    return _samples(spark, sf).select("session_id", "sample_id", fs.px_to_mm(mm, F.col("left_px"), radius, F.col("left_px").isNotNull()).alias("mm"))


add(
    "px_to_mm",
    px_to_mm,
    query(
        ("samples",),
        f"""SELECT session_id, sample_id, nullif({r('coalesce(m, CASE WHEN p IS NOT NULL AND p <> 0 THEN CASE WHEN i > 5 THEN p / (2e0 * i) * 117e-1 ELSE p * 1e-1 END END)', 3)}, 0) AS mm
        FROM (SELECT *, left_px AS p, CASE WHEN sample_id % 5 = 0 THEN left_mm END AS m,
              (CASE WHEN sample_id % 4 = 0 THEN 3e-3 ELSE CAST(sample_id % 9 AS DOUBLE) * 1e-2 END) * 1280e0 AS i FROM samples)""",
    ),
)


def frame_project(spark, sf):
    """Nested frame to sample row."""
    s = _samples(spark, sf)
    pupil = lambda side: F.struct(F.col(f"{side}_px").isNotNull().alias("detected"), F.col(f"{side}_px").alias("diameterPx"), F.col(f"{side}_mm").alias("diameterMm"))
    frame = s.select(
        "session_id", "sample_id",
        F.struct(
            F.col("frame_ts_ms").alias("timestamp"),
            F.struct(pupil("left").alias("leftPupil"), pupil("right").alias("rightPupil")).alias("pupilData"),
            F.struct(F.col("status").alias("status")).alias("tracking"),
        ).alias("frame"),
    )
    left = F.col("frame.pupilData.leftPupil")
    return frame.select(
        "session_id", "sample_id", half_up(F.col("frame.timestamp") - F.lit(fx.ONSET_MS)).alias("rel_ms"),
        F.when(left["detected"], left["diameterPx"]).alias("left_px"), half_up(left["diameterMm"], 3).alias("left_mm"),
        fs.status_confidence(F.col("frame.tracking.status")).alias("tracking_confidence"),
    )


add(
    "frame_project",
    frame_project,
    query(
        ("samples",),
        f"""SELECT session_id, sample_id, {r('frame_ts_ms - 1500e0')} AS rel_ms, left_px, {r('left_mm', 3)} AS left_mm,
            CASE status WHEN 'GOOD' THEN 95e0 WHEN 'DEGRADED' THEN 65e0 ELSE 20e0 END AS tracking_confidence FROM samples""",
    ),
)
def frame_samples(spark, sf):
    """Nested frames to samples, both eyes; irises, eyes and measured millimetres are absent in turn."""
    rows = _samples(spark, sf)
    e = F.col("sample_id")
    pupil = lambda side, k: F.struct(
        F.col(f"{side}_px").isNotNull().alias("detected"), F.col(f"{side}_px").alias("diameterPx"), F.when(e % k == 0, F.col(f"{side}_mm")).alias("diameterMm"),
        F.when(F.col(f"{side}_px").isNotNull(), "DETECTED").otherwise("LOST").alias("status"),
    )
    radius = lambda k: F.when(e % k == 0, F.lit(0.003)).when(e % k > 1, (e % 9).cast("double") * F.lit(0.01))
    eyes = F.struct((e % 3 != 0).alias("leftEye"), F.when(e % 2 == 0, F.lit(True)).alias("rightEye"), radius(4).alias("leftIrisRadiusNorm"), radius(6).alias("rightIrisRadiusNorm"))
    frame = F.struct(
        F.col("frame_ts_ms").alias("timestamp"), F.struct(pupil("left", 5).alias("leftPupil"), pupil("right", 3).alias("rightPupil")).alias("pupilData"),
        eyes.alias("ocularData"), F.struct(F.col("status").alias("status")).alias("tracking"),
    )
    rows = rows.select("session_id", "sample_id", frame.alias("frame")).select("session_id", "sample_id", *fs.frame_to_sample(F.col("frame"), F.lit(fx.ONSET_MS)))
    return rows.select(*[settle(F.col(c), 6).alias(c) if c.endswith("iris_px") else F.col(c) for c in rows.columns])


def _side(side, k):
    scaled = f"CASE WHEN {side}_px IS NOT NULL AND {side}_px <> 0 THEN CASE WHEN {side}_i > 5 THEN {side}_px / (2e0 * {side}_i) * 117e-1 ELSE {side}_px * 1e-1 END END"
    mm = r(f"coalesce(CASE WHEN sample_id % {k} = 0 THEN {side}_mm END, {scaled})", 3)
    return f"{side}_px, {s(f'{side}_i', 6)} AS {side}_iris_px, nullif({mm}, 0) AS {side}_mm"


def _iris(k):
    return f"CASE WHEN sample_id % {k} = 0 THEN 3e-3 WHEN sample_id % {k} > 1 THEN CAST(sample_id % 9 AS DOUBLE) * 1e-2 END * 1280e0"


add(
    "frame_samples",
    frame_samples,
    query(
        ("samples",),
        f"""SELECT session_id, sample_id, {r('frame_ts_ms - 1500e0')} AS rel_ms, {_side('left', 5)}, {_side('right', 3)}, CASE WHEN left_px IS NULL THEN 'LOST' ELSE 'DETECTED' END AS tracking_status,
            CASE status WHEN 'GOOD' THEN 95e0 WHEN 'DEGRADED' THEN 65e0 ELSE 20e0 END AS tracking_confidence, left_px IS NULL AND right_px IS NULL AND (sample_id % 3 = 0 OR sample_id % 2 <> 0) AS is_blink
            FROM (SELECT *, {_iris(4)} AS left_i, {_iris(6)} AS right_i FROM samples)""",
    ),
)
add(
    "blink_flag",
    lambda spark, sf: _samples(spark, sf).select(
        "session_id", "sample_id",
        fs.is_blink(F.col("left_px").isNotNull(), F.col("right_px").isNotNull(), F.col("sample_id") % 3 != 0, F.lit(True)).alias("is_blink"),
    ),
    query(("samples",), "SELECT session_id, sample_id, left_px IS NULL AND right_px IS NULL AND sample_id % 3 = 0 AS is_blink FROM samples"),
)
add(
    "session_ids",
    lambda spark, sf: fx.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("ts")).select(
        "user_id", fs.session_label(F.col("ts"), F.col("user_id")).alias("label")
    ),
    "SELECT user_id, 'OP-' || strftime(min(ts), '%Y%m%d') || '-' || upper(substr(sha256(CAST(user_id AS VARCHAR)), 1, 4)) AS label FROM events GROUP BY user_id",
)


def anisocoria_gauge(spark, sf):
    normal, offset = fs.anisocoria_gauge(F.col("left_mm"), F.col("right_mm"))
    return _samples(spark, sf).select("session_id", "sample_id", normal.alias("is_normal"), half_up(offset, 2).alias("offset_pct"))


add(
    "anisocoria_gauge",
    anisocoria_gauge,
    query(
        ("samples",),
        f"""SELECT session_id, sample_id, coalesce(abs(left_mm - right_mm) < 4e-1, true) AS is_normal,
            CASE WHEN left_mm IS NULL OR right_mm IS NULL THEN 51e0
                 ELSE {r('greatest(10e0, least(90e0, 50e0 + (left_mm - right_mm) * 40e0))', 2)} END AS offset_pct FROM samples""",
    ),
)
add(
    "quality_tier",
    lambda spark, sf: fx.recording(spark, sf).summary().select(
        "session_id", "recording_quality", fs.confidence_tier(F.col("recording_quality")).alias("document_tier"), fs.quality_tier(F.col("recording_quality")).alias("code_tier")
    ),
    query(
        ("summary",),
        """SELECT session_id, recording_quality, CASE WHEN recording_quality >= 95 THEN 'Excellent' WHEN recording_quality >= 80 THEN 'Good'
           WHEN recording_quality >= 60 THEN 'Unstable' ELSE 'Recalibration' END AS document_tier,
           CASE WHEN recording_quality >= 80 THEN 'HIGH' WHEN recording_quality >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS code_tier FROM summary""",
    ),
)


# ---- cleaning -----------------------------------------------------------------------------------
def gap_repair(spark, sf):
    rec = fx.recording(spark, sf)
    return rec.per_eye(signal.repair_gaps).select(
        "session_id", "eye", "sample_id", "time_ms", half_up(F.col("raw_mm"), 6).alias("raw_mm"), half_up(F.col("confidence"), 4).alias("confidence"), "is_interpolated"
    )


add(
    "gap_repair",
    gap_repair,
    query(("repaired",), f"SELECT session_id, eye, sample_id, time_ms, {r('raw_mm', 6)} AS raw_mm, {r('confidence', 4)} AS confidence, is_interpolated FROM repaired"),
)


def _after_repair(fn, out, digits=4):
    def run(spark, sf):
        rows = fx.recording(spark, sf).per_eye(lambda df, lay: fn(signal.repair_gaps(df, lay), lay))
        return rows.select("session_id", "eye", "sample_id", half_up(F.col(out), digits).alias(out))

    return run


add("sg5_smooth", _after_repair(signal.smooth, "clean_mm", 6), query(("smoothed",), f"SELECT session_id, eye, sample_id, {r('clean_mm', 6)} AS clean_mm FROM smoothed"))
_seven = "(a3 * -2e0 + a2 * 3e0 + a1 * 6e0 + raw_mm * 7e0 + b1 * 6e0 + b2 * 3e0 + b3 * -2e0) / 21e0"
add(
    "sg7_smooth",
    _after_repair(lambda df, lay: signal.smooth(df, lay, size=7), "clean_mm", 6),
    query(
        ("tapped",),
        f"""SELECT session_id, eye, sample_id, {r(f'CASE WHEN n < 3 THEN raw_mm WHEN n < 5 THEN {SHORT} WHEN n < 7 THEN {FIVE} WHEN a3 IS NOT NULL AND b3 IS NOT NULL THEN {_seven} ELSE {EDGE} END', 6)} AS clean_mm FROM tapped""",
    ),
)
add(
    "velocity",
    _after_repair(lambda df, lay: signal.differentiate(signal.smooth(df, lay), lay), "velocity"),
    query(("moving",), f"SELECT session_id, eye, sample_id, {r('velocity', 4)} AS velocity FROM moving"),
)
add(
    "acceleration",
    _after_repair(
        lambda df, lay: signal.differentiate(signal.differentiate(signal.smooth(df, lay), lay), lay, value="velocity", out="acceleration"), "acceleration", 3
    ),
    query(("moving",), f"SELECT session_id, eye, sample_id, {r('acceleration', 3)} AS acceleration FROM ({slope_sql('moving', 'velocity', 'acceleration')})"),
)
add(
    "session_summary",
    lambda spark, sf: fx.recording(spark, sf).summary(),
    query(("summary",), "SELECT session_id, frames, duration_ms, average_fps, valid_ratio, mean_confidence, recording_quality FROM summary"),
)


# ---- features -----------------------------------------------------------------------------------
def _features(spark, sf):
    return fx.recording(spark, sf).features()


add(
    "baseline_stats",
    lambda spark, sf: _features(spark, sf).select("session_id", "eye", half_up(F.col("baseline"), 6).alias("baseline"), half_up(F.col("sigma"), 6).alias("sigma"), "points"),
    query(("stats",), f"SELECT session_id, eye, {r('baseline', 6)} AS baseline, {r('sigma', 6)} AS sigma, points FROM stats"),
)
add(
    "nadir",
    lambda spark, sf: _features(spark, sf).select("session_id", "eye", half_up(F.col("nadir"), 6).alias("nadir"), "nadir_ms", half_up(F.col("amplitude"), 6).alias("amplitude")),
    query(("stats",), f"SELECT session_id, eye, {r('nadir', 6)} AS nadir, nadir_ms, {r('amplitude', 6)} AS amplitude FROM stats"),
)
add("latency", lambda spark, sf: _features(spark, sf).select("session_id", "eye", "latency_ms"), query(("features",), "SELECT session_id, eye, latency_ms FROM features"))
add(
    "mcv",
    lambda spark, sf: _features(spark, sf).select("session_id", "eye", half_up(F.col("peak_speed"), 6).alias("peak_speed")),
    query(("features",), f"SELECT session_id, eye, {r('peak_speed', 6)} AS peak_speed FROM features"),
)
add("recovery75", lambda spark, sf: _features(spark, sf).select("session_id", "eye", "recovery_ms"), query(("features",), "SELECT session_id, eye, recovery_ms FROM features"))
add("plr_kinetics", lambda spark, sf: fx.recording(spark, sf).metrics(), query(("metrics",), "SELECT * FROM metrics"))
add(
    "eye_metrics",
    lambda spark, sf: fx.recording(spark, sf).metrics().groupBy("eye", "response_pattern").agg(F.count(F.lit(1)).alias("series"), F.max("latency_ms").alias("max_latency_ms")),
    query(("metrics",), "SELECT eye, response_pattern, count(*) AS series, max(latency_ms) AS max_latency_ms FROM metrics GROUP BY ALL"),
)
ASYM = ("baseline_anisocoria_mm", "min_anisocoria_mm", "constriction_pct_diff", "amplitude_diff_mm", "latency_diff_ms", "mcv_diff_mm_s", "asymmetry_severity")
add("asymmetry", lambda spark, sf: fx.recording(spark, sf).asymmetry().select("session_id", *ASYM), query(("asym",), f"SELECT session_id, {', '.join(ASYM)} FROM asym"))
add(
    "reliability",
    lambda spark, sf: fx.recording(spark, sf).report().select("session_id", "overall_quality", "is_reliable"),
    query(("report",), "SELECT session_id, overall_quality, is_reliable FROM report"),
)
add(
    "report_notes",
    lambda spark, sf: fx.recording(spark, sf).report().select("session_id", F.concat_ws("\n", "notes").alias("notes")),
    query(
        ("report",),
        """SELECT session_id, concat_ws(chr(10), CASE WHEN NOT is_reliable THEN 'Recording quality below physiological threshold; result marked INCONCLUSIVE.' END,
           CASE WHEN asymmetry_severity <> 'SYMMETRIC' THEN printf('Significant bilateral asymmetry detected (%s): ΔConstriction = %.1f%%, Anisocoria = %.2f mm.',
             replace(asymmetry_severity, '_', ' '), constriction_pct_diff, baseline_anisocoria_mm) END,
           CASE WHEN left_response_pattern = 'NON_REACTIVE_FIXED' THEN 'Left pupil non-reactive / fixed under light stimulus.' END,
           CASE WHEN right_response_pattern = 'NON_REACTIVE_FIXED' THEN 'Right pupil non-reactive / fixed under light stimulus.' END,
           CASE WHEN left_response_pattern = 'SLUGGISH_REDUCED' THEN 'Left pupil exhibited sluggish / reduced constriction velocity.' END,
           CASE WHEN right_response_pattern = 'SLUGGISH_REDUCED' THEN 'Right pupil exhibited sluggish / reduced constriction velocity.' END) AS notes FROM report""",
    ),
)
