"""Streaming queries, drained over the event files; the SQL checks compute the same from the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numeric import half_up, settle
from ...operators import agreement
from ...session import scratch
from ...sources import stores
from ...streaming import jobs, operators, pipelines
from ...streaming.ordered import recording_phases
from .. import fixtures as fx
from .registry import add
from .storage import _finals
from .sql import case, cte, query, r, rquery, s


def frames(spark, sf, pattern="events*.parquet", files_per_batch=8):
    """Event files as a frame stream."""
    e = F.col("event_id")
    px = F.when(F.col("event_type") != "error", half_up(F.col("value") + F.lit(10.0), 2))
    return jobs.event_stream(spark, sf, pattern, files_per_batch).select(
        F.col("user_id").alias("session_id"), e.alias("sample_id"), "ts", F.floor(F.unix_micros("ts") / 1000).cast("double").alias("frame_ts_ms"), px.alias("px"),
        (px / F.lit(20.0)).alias("mm"), (F.lit(0.3) + (e % 7).cast("double") * F.lit(0.05)).alias("x"), (F.lit(0.4) + (e % 3).cast("double") * F.lit(0.01)).alias("y"),
    )


cte(
    "sframes",
    (),
    f"""SELECT user_id AS session_id, event_id AS sample_id, ts, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS frame_ts_ms, CASE WHEN event_type <> 'error' THEN {r('value + 10e0', 2)} END AS px,
        3e-1 + CAST(event_id % 7 AS DOUBLE) * 5e-2 AS x, 4e-1 + CAST(event_id % 3 AS DOUBLE) * 1e-2 AS y FROM events""",
)
_ms = lambda c: F.unix_millis(c)


def drained(spark, sf, name, operator):
    """The result of `operator(frames)` over the whole stream, which is closed at its end."""
    ending = jobs.Ending(frames(spark, sf))
    return jobs.drain(operator(ending.stream), name, ending=ending)[0]


def stream_fps(spark, sf):
    rows = drained(spark, sf, "fps", lambda f: operators.frames_per_second(f, "1 day"))
    return rows.select("session_id", _ms("start").alias("start_ms"), "frames")


add(
    "stream_fps",
    stream_fps,
    query(
        ("sframes",),
        "SELECT session_id, epoch_ms(d) AS start_ms, n AS frames FROM (SELECT session_id, date_trunc('day', ts) AS d, count(*) AS n FROM sframes GROUP BY ALL)",
    ),
)


def stream_activity(spark, sf):
    rows = drained(spark, sf, "activity", lambda f: operators.rolling_activity(f, "2 days", "1 day"))
    return rows.select(_ms("start").alias("start_ms"), _ms("end").alias("end_ms"), "frames", "valid")


add(
    "stream_activity",
    stream_activity,
    query(
        ("sframes",),
        """SELECT epoch_ms(d) AS start_ms, epoch_ms(d + INTERVAL 2 DAY) AS end_ms, count(*) AS frames, count(px) AS valid
           FROM (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS d, px FROM sframes, range(2) t(k)) GROUP BY d""",
    ),
)


def stream_sessions(spark, sf):
    rows = drained(spark, sf, "sessions", lambda f: operators.closed_sessions(f, "12 hours"))
    return rows.select("session_id", _ms("start").alias("start_ms"), _ms("end").alias("end_ms"), "frames")


add(
    "stream_sessions",
    stream_sessions,
    query(
        ("sframes",),
        """SELECT session_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 12 HOUR) // 1000 AS end_ms, count(*) AS frames FROM (
             SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, sample_id) AS g
             FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, sample_id) AS p FROM sframes))
           GROUP BY session_id, g""",
    ),
)


def stream_dedup(spark, sf):
    """The event stream read twice (as a camera that repeats frames) yields every frame once."""
    twice = frames(spark, sf).select("session_id", "sample_id", "ts", "frame_ts_ms").union(frames(spark, sf).select("session_id", "sample_id", "ts", "frame_ts_ms"))
    rows, _ = jobs.drain(operators.distinct_frames(twice, ["session_id", "sample_id"]), "dedup")
    return rows.select("session_id", "sample_id", "frame_ts_ms")


add("stream_dedup", stream_dedup, query(("sframes",), "SELECT session_id, sample_id, frame_ts_ms FROM sframes"))


def stream_throttle(spark, sf):
    rows = drained(spark, sf, "throttle", lambda f: operators.throttled(f, 3_600_000.0 * 6))
    return rows.select("session_id", "sample_id", "frame_ts_ms")


cte("snum", ("sframes",), "SELECT *, px / 2e0 AS radius, px / 20e0 AS mm, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS rn FROM sframes")
cte("svalid", ("sframes",), "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS rn FROM sframes WHERE px IS NOT NULL")
add(
    "stream_throttle",
    stream_throttle,
    rquery(
        ("svalid",), "walk",
        """SELECT session_id, sample_id, rn, frame_ts_ms, frame_ts_ms AS last_kept, true AS kept FROM svalid WHERE rn = 1
           UNION ALL SELECT f.session_id, f.sample_id, f.rn, f.frame_ts_ms, CASE WHEN f.frame_ts_ms - w.last_kept >= 21600000 THEN f.frame_ts_ms ELSE w.last_kept END, f.frame_ts_ms - w.last_kept >= 21600000
             FROM walk w JOIN svalid f ON f.session_id = w.session_id AND f.rn = w.rn + 1""",
        "SELECT session_id, sample_id, frame_ts_ms FROM walk WHERE kept",
    ),
)


def stream_ema(spark, sf):
    rows = drained(spark, sf, "ema", operators.stabilised)
    return rows.select("session_id", "sample_id", "track_status", *[half_up(F.col(c), 5).alias(c) for c in ("smooth_px", "smooth_x", "smooth_y", "smooth_mm")])


_jump = "sqrt((o.x - w.x) * (o.x - w.x) + (o.y - w.y) * (o.y - w.y)) > 12e-2"
_a, _b = f"CASE WHEN {_jump} THEN 85e-2 ELSE 65e-2 END", f"CASE WHEN {_jump} THEN (1e0 - 85e-2) ELSE (1e0 - 65e-2) END"
_mix = lambda c: f"CASE WHEN o.px IS NULL THEN NULL WHEN w.radius IS NULL THEN o.{c} ELSE ({_a}) * o.{c} + ({_b}) * w.{c} END"
add(
    "stream_ema",
    stream_ema,
    rquery(
        ("snum",), "walk",
        f"""SELECT session_id, sample_id, rn, radius, CASE WHEN px IS NOT NULL THEN x END AS x, CASE WHEN px IS NOT NULL THEN y END AS y, mm, CASE WHEN px IS NULL THEN 1 ELSE 0 END AS lost FROM snum WHERE rn = 1
            UNION ALL SELECT o.session_id, o.sample_id, o.rn, {_mix('radius')}, {_mix('x')}, {_mix('y')},
              CASE WHEN o.px IS NULL THEN NULL WHEN w.radius IS NULL THEN o.mm ELSE {r(f'({_a}) * o.mm + ({_b}) * w.mm', 2)} END, CASE WHEN o.px IS NULL THEN w.lost + 1 ELSE 0 END
              FROM walk w JOIN snum o ON o.session_id = w.session_id AND o.rn = w.rn + 1""",
        f"""SELECT session_id, sample_id, CASE WHEN lost = 0 THEN 'DETECTED' WHEN lost <= 4 THEN 'UNCERTAIN' ELSE 'LOST' END AS track_status,
            {r('radius * 2e0', 5)} AS smooth_px, {r('x', 5)} AS smooth_x, {r('y', 5)} AS smooth_y, {r('mm', 5)} AS smooth_mm FROM walk""",
    ),
)


def stream_baseline(spark, sf):
    """Live baseline state; coarse sizes make some windows stable."""
    coarse = F.when(F.col("px").isNotNull(), F.floor(F.col("px") / 8) * F.lit(0.1) + F.lit(40.0))
    return drained(spark, sf, "baseline", lambda f: operators.baseline_states(f.withColumn("left_px", coarse).withColumn("right_px", coarse)))


cte(
    "sisl",
    ("sframes",),
    """SELECT *, floor(px / 8) * 1e-1 + 40e0 AS v, sum(reset) OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS island FROM (
         SELECT *, CASE WHEN count(px) OVER w = 0 AND count(*) OVER w = 5 THEN 1 ELSE 0 END AS reset FROM sframes
         WINDOW w AS (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
)
add(
    "stream_baseline",
    stream_baseline,
    query(
        ("sisl",),
        f"""SELECT session_id, sample_id, CAST(k AS INTEGER) AS window_count, {case([('k >= 6 AND hi - lo <= 5e-1', "'BASELINE_STABLE'"), ('k > 0', "'COLLECTING_RAW_BASELINE'")], "'IDLE'")} AS state
            FROM (SELECT a.session_id, a.sample_id, count(b.vn) AS k, max(b.v) AS hi, min(b.v) AS lo FROM (SELECT *, count(px) OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS seen FROM sisl) a
              LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS vn FROM sisl WHERE px IS NOT NULL) b
                ON a.session_id = b.session_id AND a.island = b.island AND b.vn BETWEEN a.seen - 5 AND a.seen GROUP BY 1, 2)""",
    ),
)


def stream_finished(spark, sf):
    return drained(spark, sf, "finished", lambda f: operators.finished_recordings(f, 86_400_000.0))


add(
    "stream_finished",
    stream_finished,
    query(
        ("sframes",),
        """SELECT session_id, min(epoch_us(ts)) / 1000 AS first_ms, max(epoch_us(ts)) / 1000 AS last_ms, count(*) AS frames FROM sframes GROUP BY session_id""",
    ),
)


# The protocol in days instead of seconds, as the given frames of a session lie days apart.
_DAY = 86_400_000
_PHASES = (3 * _DAY, _DAY, 7 * _DAY)


def stream_phases(spark, sf):
    """The recording of each session, phase by phase; it closes at its end also when no further frame comes."""
    return drained(spark, sf, "phases", lambda f: recording_phases(f, *_PHASES, idle_ms=_DAY, delay=operators.DELAY))


add(
    "stream_phases",
    stream_phases,
    query(
        ("sframes",),
        f"""SELECT session_id, CASE WHEN phase = 'COMPLETE' AND count(px) FILTER (frame_ts_ms < start + after) = 0 THEN 'FAILED_INCONCLUSIVE' ELSE phase END AS phase,
            CAST(start + after AS BIGINT) AS at_ms, count(*) FILTER (frame_ts_ms < start + after) AS frames, count(px) FILTER (frame_ts_ms < start + after) AS valid
            FROM (SELECT *, min(frame_ts_ms) OVER (PARTITION BY session_id) AS start FROM sframes),
              (VALUES ('BASELINE', 0), ('STIMULUS', {3 * _DAY}), ('CONSTRICTION_RECOVERY', {4 * _DAY}), ('PROCESSING', {11 * _DAY}), ('COMPLETE', {11 * _DAY})) t(phase, after)
            GROUP BY session_id, phase, start, after""",
    ),
)


def _methods(spark, sf):
    a = frames(spark, sf).select("session_id", "sample_id", "ts", "frame_ts_ms", F.col("px").alias("left_px"), F.col("px").alias("right_px"), F.lit(320.0).alias("center_x"), F.lit(240.0).alias("center_y"))
    e = F.col("sample_id")
    px = F.when(e % 13 != 0, F.col("px") + ((e % 5) - 2).cast("double") * F.lit(0.5))
    b = frames(spark, sf).select(
        "session_id", F.col("ts").alias("ts_b"), (F.col("frame_ts_ms") + F.when(e % 9 == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("frame_ts_ms_b"), px.alias("left_px_b"), px.alias("right_px_b"),
        (F.lit(320) + e % 4).cast("double").alias("center_x_b"), F.lit(240.0).alias("center_y_b"),
    )
    return a, b


cte(
    "smatch",
    ("sframes",),
    """SELECT session_id, sample_id, frame_ts_ms, px, CASE WHEN sample_id % 13 <> 0 THEN px + CAST(sample_id % 5 - 2 AS DOUBLE) * 5e-1 END AS pb, CAST(sample_id % 4 AS DOUBLE) AS dist FROM sframes WHERE sample_id % 9 <> 0""",
)


def stream_match(spark, sf):
    """Stream-stream join of two methods; stale rows of the second find no partner."""
    rows, _ = jobs.drain(operators.matched(*_methods(spark, sf)), "match")
    return rows.select("session_id", "sample_id", half_up(F.abs(F.col("left_px_b") - F.col("left_px")), 4).alias("diff_px"))


add("stream_match", stream_match, query(("smatch",), f"SELECT session_id, sample_id, {r('abs(pb - px)', 4)} AS diff_px FROM smatch"))


def stream_agreement(spark, sf):
    m = operators.matched(*_methods(spark, sf))
    a = m.select("session_id", "sample_id", F.col("frame_ts_ms").alias("ts_ms"), "left_px", "right_px", "center_x", "center_y", "left_px_b", "right_px_b", "center_x_b", "center_y_b")
    path, _ = pipelines.running_agreement(agreement.compare_matched(a))
    rows = pipelines.latest_statistics(spark, path)
    return rows.select("session_id", "n", "valid_comparisons", *[settle(F.col(c), 4).alias(c) for c in ("mean_diff_px", "median_diff_px", "mean_distance_px", "agreement_pct", "left_mean_px")])


add(
    "stream_agreement",
    stream_agreement,
    query(
        ("smatch",),
        f"""SELECT k.session_id, n, valid_comparisons, mean_diff_px, median_diff_px, mean_distance_px, agreement_pct, coalesce(left_mean_px, 0e0) AS left_mean_px FROM (
              SELECT session_id, count(*) AS n, count(pb) AS valid_comparisons, {s('coalesce(avg(abs(pb - px)), 0e0)', 4)} AS mean_diff_px,
                {s('coalesce(list_sort(list(abs(pb - px)) FILTER (pb IS NOT NULL))[count(pb) * 2 // 2 // 2 + 1], 0e0)', 4)} AS median_diff_px,
                {s('coalesce(avg(dist) FILTER (pb IS NOT NULL), 0e0)', 4)} AS mean_distance_px, {s('count(*) FILTER ((px IS NULL) = (pb IS NULL)) / count(*) * 100e0', 4)} AS agreement_pct
              FROM (SELECT * FROM smatch QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms DESC, sample_id DESC) <= 300) GROUP BY 1) k
            LEFT JOIN (SELECT session_id, {s('avg(pb)', 4)} AS left_mean_px FROM (SELECT * FROM smatch WHERE pb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms DESC, sample_id DESC) <= 300) GROUP BY 1) USING (session_id)""",
    ),
)


_PARTS = 12


def stream_late(spark, sf):
    """The events in twelve files, one a batch; some rows come two files late, some have values out of range. Every row with what became of it."""
    e = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    last = e.agg(F.max("event_id")).first()[0]
    place = F.floor(F.col("event_id") * _PARTS / F.lit(last + 1)) + F.when(F.col("event_id") % 41 == 3, 2).otherwise(0)
    folder = scratch(spark, "parts")
    for k in range(_PARTS):  # a file stream goes by the files' times
        e.where(F.least(place, F.lit(_PARTS - 1)) == k).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    table, _, _ = pipelines.split_rejects(source, "late", 3_600_000, F.col("value") > 99)
    return table.select("event_id", "batch", "reason")


add(
    "stream_late",
    stream_late,
    f"""WITH p AS (SELECT event_id, ts, value, CAST(least({_PARTS - 1}, event_id * {_PARTS} // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 41 = 3 THEN 2 ELSE 0 END) AS BIGINT) AS batch FROM events),
          b AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM p GROUP BY batch)
        SELECT event_id, batch, CASE WHEN ts IS NULL THEN 'untimed' WHEN value > 99 THEN 'bad' WHEN epoch_ms(ts) < epoch_ms(newest) - 3600000 THEN 'late' ELSE 'accepted' END AS reason FROM p JOIN b USING (batch)""",
)


def stream_alerts(spark, sf):
    """Reports written as files, read as a stream and triaged on arrival."""
    path = scratch(spark, "reports")
    fx.recording(spark, sf).report().write.parquet(path)
    reports = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    rows, _ = jobs.drain(pipelines.alerts(reports, fx.contexts(spark, sf)).select("session_id", "urgency", "headline", "n_critical", "n_warning"), "alerts")
    return rows


add("stream_alerts", stream_alerts, query(("assessed",), "SELECT session_id, urgency, headline, n_critical, n_warning FROM assessed WHERE has_report"))


def stream_close(spark, sf):
    """Finished sessions trigger the batch kinetics; the reliable reports end up in the final store."""
    store = scratch(spark, "final")
    ending = jobs.Ending(frames(spark, sf))
    done = operators.finished_recordings(ending.stream, 86_400_000.0)
    pipelines.close_and_report(done, lambda ids: _finals(spark, sf).join(ids, "session_id", "left_semi"), store, ending)
    return stores.read_finals(spark, store).select("session_id", "baseline_left_pupil_px", "baseline_right_pupil_px")


add(
    "stream_close",
    stream_close,
    query(
        ("finals",),
        "SELECT session_id, baseline_left_pupil_px, baseline_right_pupil_px FROM finals",
    ),
)
