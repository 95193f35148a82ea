"""Queries on stores, retention, exports and the feature vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numeric import settle
from ...operators import audit, features, live
from ...operators.components import written
from ...session import scratch
from ...streaming import jobs
from ...sources import exports, stores
from .. import fixtures as fx
from . import scans
from .images import SMALL, _areas, _hashed_leaks, _masks, _near_pairs, _raw_masks
from .registry import ORACLES, add
from .sql import cte, query, r, s
from .triage import assessed


def _raw(spark, sf):
    return stores.raw_records(fx.recording(spark, sf).samples)


def _finals(spark, sf):
    rec = fx.recording(spark, sf)
    done = rec.samples.groupBy("session_id").agg(F.max("ts").alias("ts"))
    return stores.final_records(rec.report(), fx.stimuli(rec.samples), done, stores.px_at_onset(rec.samples))


def _stored(spark, sf):
    """The final records, computed once for several writes."""
    return written(_finals(spark, sf), "finals")


cte(
    "raws",
    ("samples",),
    f"""SELECT session_id, sample_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(extract(microsecond FROM ts) % 1000000 / 1000)::INT AS VARCHAR), 3, '0') || 'Z' AS timestamp, {r('left_px', 2)} AS left_pupil_px,
        {r('right_px', 2)} AS right_pupil_px, frame_ts_ms AS perf_timestamp_ms FROM samples WHERE left_px > 0 AND right_px > 0""",
)
cte(
    "finals",
    ("report", "samples"),
    """SELECT session_id, ts, left_baseline_px AS baseline_left_pupil_px, right_baseline_px AS baseline_right_pupil_px, coalesce(olp, left_baseline_px) AS stimulus_left_pupil_px,
       coalesce(orp, right_baseline_px) AS stimulus_right_pupil_px, 1500e0 AS stimulus_onset_ms, 200e0 AS stimulus_duration_ms
       FROM report JOIN (SELECT session_id, max(ts) AS ts FROM samples GROUP BY 1) USING (session_id)
       LEFT JOIN (SELECT session_id, arg_max(left_px, frame_ts_ms) AS olp, arg_max(right_px, frame_ts_ms) AS orp FROM samples WHERE time_ms <= 0 AND left_px IS NOT NULL GROUP BY 1) USING (session_id)
       WHERE is_reliable""",
)
FINAL = ("session_id", "baseline_left_pupil_px", "baseline_right_pupil_px", "stimulus_left_pupil_px", "stimulus_right_pupil_px", "stimulus_onset_ms", "stimulus_duration_ms")


def append_read(spark, sf):
    """Write the raw store and read it back."""
    path = scratch(spark, "raw")
    stores.append(_raw(spark, sf), path)
    return stores.read_raw(spark, path).select("session_id", "sample_id", "timestamp", "left_pupil_px", "right_pupil_px", "perf_timestamp_ms")


add("append_read", append_read, query(("raws",), "SELECT * FROM raws"))
add("final_records", lambda spark, sf: _finals(spark, sf).select(*FINAL), query(("finals",), f"SELECT {', '.join(FINAL)} FROM finals"))


def dedup_insert(spark, sf):
    """Insert even sessions, then all of them twice: every session is stored once."""
    path, rows = scratch(spark, "final"), _stored(spark, sf)
    stores.insert_finals(rows.where("session_id % 2 = 0"), path)
    stores.insert_finals(rows.unionByName(rows), path)
    return stores.read_finals(spark, path).select(*FINAL)


add("dedup_insert", dedup_insert, query(("finals",), f"SELECT {', '.join(FINAL)} FROM finals"))


def delete_by_key(spark, sf):
    path = scratch(spark, "final")
    stores.insert_finals(_finals(spark, sf), path)
    stores.delete_ids(stores.read_finals(spark, path).where("session_id % 4 = 0"), path)
    return stores.read_finals(spark, path).select("session_id", "baseline_left_pupil_px")


def delete_then_reinsert(spark, sf):
    """Sessions deleted and inserted again, twice, are there once."""
    path = scratch(spark, "final")
    rows = _stored(spark, sf)
    stores.insert_finals(rows, path)
    for _ in range(2):
        stores.delete_ids(stores.read_finals(spark, path).where("session_id % 4 = 0"), path)
        stores.insert_finals(rows, path)
    return stores.read_finals(spark, path).select(*FINAL)


add("delete_then_reinsert", delete_then_reinsert, query(("finals",), f"SELECT {', '.join(FINAL)} FROM finals"))


def clear_store(spark, sf):
    """A cleared store starts anew; another keeps its rows."""
    one, two = scratch(spark, "final"), scratch(spark, "final")
    rows = _stored(spark, sf)
    stores.insert_finals(rows, one)
    stores.insert_finals(rows, two)
    stores.clear(spark, one, stores.FINAL_RECORD)
    stores.insert_finals(rows.where("session_id % 2 = 1"), one)
    tag = lambda path, name: stores.read_finals(spark, path).select(F.lit(name).alias("store"), "session_id")
    return tag(one, "cleared").unionByName(tag(two, "kept"))


add("clear_store", clear_store, query(("finals",), "SELECT 'cleared' AS store, session_id FROM finals WHERE session_id % 2 = 1 UNION ALL SELECT 'kept', session_id FROM finals"))


def publish_rows(spark, sf):
    """What a subscriber sees of inserts between which rows are deleted: every insert once."""
    path = scratch(spark, "final")
    rows = _stored(spark, sf)
    stores.insert_finals(rows.where("session_id % 2 = 0"), path)
    stores.delete_ids(stores.read_finals(spark, path).where("session_id % 4 = 0"), path)
    stores.insert_finals(rows, path)
    seen, _ = jobs.drain(stores.new_rows(spark, path, stores.FINAL_RECORD), "seen")
    return seen.groupBy("session_id").agg(F.count(F.lit(1)).alias("times"))


add("publish_rows", publish_rows, query(("finals",), "SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS times FROM finals"))
add("delete_by_key", delete_by_key, query(("finals",), "SELECT session_id, baseline_left_pupil_px FROM finals WHERE session_id % 4 <> 0"))
add(
    "raw_final_join",
    lambda spark, sf: _raw(spark, sf).join(_finals(spark, sf).select("session_id", "baseline_left_pupil_px"), "session_id").select("session_id", "sample_id", "left_pupil_px", "baseline_left_pupil_px"),
    query(("raws", "finals"), "SELECT session_id, sample_id, left_pupil_px, baseline_left_pupil_px FROM raws JOIN finals USING (session_id)"),
)
add(
    "raw_without_final",
    lambda spark, sf: _raw(spark, sf).join(_finals(spark, sf), "session_id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")),
    query(("raws", "finals"), "SELECT session_id, count(*) AS n FROM raws WHERE session_id NOT IN (SELECT session_id FROM finals) GROUP BY 1"),
)
add(
    "store_counts",
    lambda spark, sf: _raw(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("raw").alias("store"), "rows").unionByName(
        _finals(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("final").alias("store"), "rows")
    ),
    query(("raws", "finals"), "SELECT 'raw' AS store, count(*) AS rows FROM raws UNION ALL SELECT 'final', count(*) FROM finals"),
)
_new = lambda: [F.col("timestamp").desc(), F.col("session_id").desc()]
add(
    "latest_final",
    lambda spark, sf: _finals(spark, sf).orderBy(*_new()).limit(1).select("session_id", "baseline_left_pupil_px"),
    query(("finals",), "SELECT session_id, baseline_left_pupil_px FROM finals ORDER BY ts DESC, session_id DESC LIMIT 1"),
)
add(
    "newest_finals",
    lambda spark, sf: _finals(spark, sf).orderBy(*_new()).limit(50).select("session_id", "timestamp"),
    query(
        ("finals",),
        "SELECT session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(floor(extract(microsecond FROM ts) % 1000000 / 1000)::INT AS VARCHAR), 3, '0') || 'Z' AS timestamp FROM finals ORDER BY ts DESC, session_id DESC LIMIT 50",
    ),
)
add(
    "session_records",
    lambda spark, sf: fx.table(spark, sf, "events").where("user_id = 7").select("event_id", "event_type", "value"),
    "SELECT event_id, event_type, value FROM events WHERE user_id = 7",
)
add(
    "retention300",
    lambda spark, sf: fx.table(spark, sf, "events").select("event_id", "user_id", "event_type").orderBy(F.col("event_id").desc()).limit(300),
    "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 300",
)
add(
    "retention_by_kind",
    lambda spark, sf: live.newest(fx.table(spark, sf, "events").select("event_type", "event_id", "user_id"), ["event_type"], [F.col("event_id").desc()], 100),
    "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100",
)


def report_json(spark, sf):
    """The JSON report, read back through its schema."""
    docs = exports.clinical_json(assessed(spark, sf))
    schema = "patient struct<patient_id: string, symptoms: array<string>>, triage struct<urgency: string, directives: array<string>>, plrReport struct<left_eye: struct<baseline_mm: double, response_pattern: string>, is_reliable: boolean>"
    d = docs.select("session_id", F.from_json("json", schema).alias("d"))
    return d.select(
        "session_id", "d.patient.patient_id", F.array_join("d.patient.symptoms", ",").alias("symptoms"), "d.triage.urgency", F.size("d.triage.directives").alias("directives"),
        F.col("d.plrReport.left_eye.baseline_mm").alias("left_baseline_mm"), F.col("d.plrReport.left_eye.response_pattern").alias("left_pattern"), "d.plrReport.is_reliable",
    )


add(
    "report_json",
    report_json,
    query(
        ("assessed",),
        """SELECT session_id, patient_id, array_to_string(symptoms, ',') AS symptoms, urgency, CAST(len(string_split(directives, chr(10))) AS INTEGER) AS directives, left_baseline_mm,
           left_response_pattern AS left_pattern, is_reliable FROM assessed WHERE has_report""",
    ),
)
add(
    "handoff_text",
    lambda spark, sf: exports.handoff_text(assessed(spark, sf)),
    query(
        ("assessed",),
        "SELECT session_id, replace(text, '~', chr(10)) AS text FROM (SELECT session_id, printf('=== CLINICAL PUPILLOMETRY REPORT ===~Patient ID: %s (Age: %d)~Mechanism: %s | Time: %s~Triage Status: %s (%s)~~[BILATERAL PLR KINETICS]~', patient_id, age_years, mechanism, time_elapsed, headline, urgency)"
        " || printf('- Baseline (D_base): OS (Left) %.2f mm | OD (Right) %.2f mm~- Constriction Nadir: OS %.2f mm | OD %.2f mm~', left_baseline_mm, right_baseline_mm, left_min_mm, right_min_mm)"
        " || printf('- Amplitude: OS %.2f mm (%.1f%%) | OD %.2f mm (%.1f%%)~', left_amplitude_mm, left_constriction_pct, right_amplitude_mm, right_constriction_pct)"
        " || printf('- Latency: OS %d ms | OD %d ms (Δ %d ms)~', left_latency_ms::BIGINT, right_latency_ms::BIGINT, latency_diff_ms::BIGINT)"
        " || printf('- Max Constriction Velocity (MCV): OS %.2f mm/s | OD %.2f mm/s~- Baseline Anisocoria: %.2f mm (%s)~~[TRIAGE DIRECTIVES]~* ', left_mcv_mm_s, right_mcv_mm_s, baseline_anisocoria_mm, asymmetry_severity)"
        " || replace(directives, chr(10), '~* ') AS text FROM assessed WHERE has_report)",
    ),
)


def feature_vector(spark, sf):
    rec = fx.recording(spark, sf)
    e = F.col("sample_id")
    pts = rec.samples.select("session_id", "frame_ts_ms", "sample_id", (F.lit(320) + e % 4).cast("double").alias("x"), (F.lit(240) + e % 3).cast("double").alias("y"))
    light = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.avg("value").alias("brightness"))
    rows = features.feature_vector(rec.asymmetry(), rec.samples, features.centre_jitter(pts, rec.heat), light)
    last = ("missing_frame_ratio", "landmark_jitter", "brightness")
    return rows.select(*[c for c in rows.columns if c not in last], *[settle(F.col(c), 4).alias(c) for c in last])


_both = ", ".join(
    f"left_{c} AS {n}_left, right_{c} AS {n}_right"
    for n, c in (("baseline", "baseline_mm"), ("min", "min_mm"), ("amplitude", "amplitude_mm"), ("constriction_pct", "constriction_pct"), ("latency", "latency_ms"), ("mcv", "mcv_mm_s"), ("recovery_time", "recovery75_ms"))
)
add(
    "feature_vector",
    feature_vector,
    query(
        ("asym", "samples"),
        f"""SELECT session_id, {_both}, baseline_anisocoria_mm AS asymmetry, missing_frame_ratio, landmark_jitter, brightness FROM asym
            JOIN (SELECT session_id, {s('count(*) FILTER (left_mm IS NULL OR right_mm IS NULL) / count(*)', 4)} AS missing_frame_ratio FROM samples GROUP BY 1) USING (session_id)
            JOIN (SELECT session_id, {s('stddev_pop(step)', 4)} AS landmark_jitter FROM (SELECT session_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step
                    FROM (SELECT session_id, frame_ts_ms, sample_id % 4 AS x, sample_id % 3 AS y FROM samples) WINDOW w AS (PARTITION BY session_id ORDER BY frame_ts_ms)) GROUP BY 1) USING (session_id)
            JOIN (SELECT user_id AS session_id, {s('avg(value)', 4)} AS brightness FROM events GROUP BY 1) USING (session_id)""",
    ),
)


def write_clean(spark, sf):
    """Valid mask samples written by split and counted back."""
    t, m = _raw_masks(spark, sf)
    path = scratch(spark, "clean")
    stores.write_valid(m, audit.validity(t, m, SMALL), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("sample").alias("samples"))


add("write_clean", write_clean, query(("raw_masks", "checked"), "SELECT split, count(*) AS pixels, count(DISTINCT sample) AS samples FROM raw_masks JOIN checked USING (split, sample) WHERE reasons = '' GROUP BY split"))


def audit_rows(spark, sf):
    a = audit.area_stats(_areas(spark, sf), ["split"])
    return exports.table_rows(a, "split", ["samples", "min_px", "max_px"])


add("audit_rows", audit_rows, query(("areas",), "SELECT split, '| **' || split || '** | ' || count(*) || ' | ' || min(area) || ' | ' || max(area) || ' |' AS line FROM areas GROUP BY split"))


def audit_json(spark, sf):
    path = scratch(spark, "audit")
    exports.audit_json(audit.class_counts(_masks(spark, sf), ("split",)), path)
    return spark.read.schema("split string, class int, pixels long, percent double").json(path)


add("audit_json", audit_json, query(("masks",), f"SELECT split, class, pixels, {r('pixels / t * 100e0', 4)} AS percent FROM (SELECT split, class, count(*) AS pixels FROM masks GROUP BY ALL) JOIN (SELECT split, count(*) AS t FROM masks GROUP BY ALL) USING (split)"))


def audit_report(spark, sf):
    """The whole audit written as JSON and read back."""
    path = scratch(spark, "audit-report")
    _, leaks = _hashed_leaks(spark, sf)
    exports.audit_report(scans.split_counts(spark, sf), audit.class_counts(_masks(spark, sf), ("split",)), _areas(spark, sf), leaks, path)
    doc = spark.read.schema(exports.REPORT).json(path)
    cell = F.explode("class_distribution").alias("c")
    size = [settle(F.col(f"pupil_area.{c}"), 4).alias(c) for c in ("min_px", "max_px", "mean_px", "median_px", "p5", "p95")]
    return doc.select("split", "pairs.*", cell, F.col("pupil_area.samples").alias("samples"), *size, "leakage_pairs", "status").select("*", "c.class", "c.pixels", "c.percent").drop("c")


add(
    "audit_report",
    audit_report,
    query(
        ("masks", "areas", "hashed", "marked"),
        f"""SELECT split, original, clean, corrupted, invalid_masks, samples, min_px, max_px, mean_px, median_px, p5, p95, leakage_pairs, CASE WHEN clean > 0 AND corrupted = 0 THEN 'READY FOR PREPROCESSING' ELSE 'NOT READY' END AS status, class, pixels, percent
            FROM (SELECT split, class, pixels, {r('pixels / t * 100e0', 4)} AS percent FROM (SELECT split, class, count(*) AS pixels FROM masks GROUP BY ALL) JOIN (SELECT split, count(*) AS t FROM masks GROUP BY ALL) USING (split))
            JOIN (SELECT split, count(*) AS samples, {s('min(area)::DOUBLE', 4)} AS min_px, {s('max(area)::DOUBLE', 4)} AS max_px, {s('avg(area)', 4)} AS mean_px, {s('median(area)', 4)} AS median_px, {s('quantile_cont(area, 5e-2)', 4)} AS p5,
                    {s('quantile_cont(area, 95e-2)', 4)} AS p95 FROM areas GROUP BY split) USING (split)
            JOIN (SELECT split, count(*) + sum((name % 7 < 6)::INT)::BIGINT AS original, count(*) AS clean, count(*) FILTER (name % 7 IN (0, 1)) AS corrupted, count(*) FILTER (name % 7 IN (2, 3)) + count(*) FILTER (name % 7 = 3) + count(*) FILTER (name % 7 = 5) AS invalid_masks
                    FROM (SELECT DISTINCT split, name FROM marked) GROUP BY split) USING (split),
              (SELECT count(*) AS leakage_pairs FROM hashed v, hashed t WHERE v.split = 'val' AND t.split = 'train' AND v.md5 <> t.md5 AND bit_count(xor(v.dhash, t.dhash)) <= 2)""",
    ),
)
add(
    "leak_rows",
    lambda spark, sf: exports.leak_rows(_near_pairs(spark, sf)[1]),
    query(
        ("near_pairs",),
        """SELECT val_sample, train_sample, printf('| `%s` | `%s` | `%s` | %.1f%% (Hamming=%d) |', val_sample::VARCHAR, train_sample::VARCHAR, CASE distance WHEN 0 THEN 'PERCEPTUAL_EXACT' ELSE 'PERCEPTUAL_NEAR' END, similarity * 100, distance) AS line FROM near_pairs""",
    ),
)
add(
    "percentile_rows",
    lambda spark, sf: exports.percentile_rows(audit.area_percentiles(_areas(spark, sf), ["split"]), ["p5", "p50", "p95"]),
    query(
        ("areas",),
        """SELECT split, 'P' || p AS name, printf('| **%s** | %s | %.2f px |', 'P' || p, split, v) AS line FROM (
             SELECT split, unnest([5, 50, 95]) AS p, unnest([quantile_cont(area, 5e-2), quantile_cont(area, 5e-1), quantile_cont(area, 95e-2)]) AS v FROM areas GROUP BY split)""",
    ),
)


def feature_csv(spark, sf):
    """The feature vectors written as CSV and read back."""
    path = scratch(spark, "features")
    rows = feature_vector(spark, sf)
    exports.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


add("feature_csv", feature_csv, ORACLES["feature_vector"])


def csv_round_trip(spark, sf):
    """Session rows written as CSV and read back with the fixed schema."""
    path = scratch(spark, "csv")
    rows = fx.recording(spark, sf).samples.select(
        F.concat(F.lit("S"), F.col("session_id").cast("string")).alias("session_id"), F.concat(F.lit("P"), (F.col("session_id") % 9).cast("string")).alias("subject_id"),
        (F.col("frame_ts_ms") / 1000).alias("time"), F.col("time_ms").between(0, 200).cast("int").alias("stimulus"), F.col("left_px").alias("left_pupil_px"), F.col("right_px").alias("right_pupil_px"),
        (F.col("sample_id") % 100 / 100).alias("brightness"),
    )
    exports.write_csv(rows, path)
    return exports.read_session_csv(spark, path)


add(
    "csv_round_trip",
    csv_round_trip,
    query(
        ("samples",),
        """SELECT 'S' || session_id AS session_id, 'P' || session_id % 9 AS subject_id, frame_ts_ms / 1000e0 AS time, (time_ms BETWEEN 0 AND 200)::INT AS stimulus, left_px AS left_pupil_px, right_px AS right_pupil_px,
           CAST(sample_id % 100 AS DOUBLE) / 100e0 AS brightness FROM samples""",
    ),
)
