"""Queries on live-stream operators in batch form, time joins and method agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numeric import half_up, settle
from ...operators import agreement, alignment, live
from ...operators.ordered import Layout
from .. import fixtures as fx
from .registry import add
from .sql import cte, query, r, rquery, s

SES = ("session_id",)
ORDER = ("frame_ts_ms", "sample_id")


# ---- time joins -----------------------------------------------------------------------------------
def _sides(rec):
    rows = rec.clean()
    # a quarter of the right eye's times lie apart from the left's, so that the outer join has something to do
    return rows.where("eye = 'L'"), rows.where("eye = 'R'").withColumn("time_ms", F.col("time_ms") + F.when(F.col("sample_id") % 4 == 0, F.lit(1)).otherwise(F.lit(0)))


add(
    "waveform_align",
    lambda spark, sf: alignment.align_eyes(*_sides(fx.recording(spark, sf))),
    query(
        ("moving",),
        f"""SELECT coalesce(l.session_id, r.session_id) AS session_id, coalesce(l.time_ms, r.time_ms) AS time_ms, {r('l.clean_mm', 2)} AS left_mm, {r('l.velocity', 2)} AS left_velocity,
            {r('r.clean_mm', 2)} AS right_mm, {r('r.velocity', 2)} AS right_velocity FROM (SELECT * FROM moving WHERE eye = 'L') l
            FULL JOIN (SELECT * REPLACE (time_ms + CASE WHEN sample_id % 4 = 0 THEN 1 ELSE 0 END AS time_ms) FROM moving WHERE eye = 'R') r ON l.session_id = r.session_id AND l.time_ms = r.time_ms""",
    ),
)
add(
    "time_union",
    lambda spark, sf: alignment.all_times(*_sides(fx.recording(spark, sf))),
    query(("moving",), "SELECT DISTINCT session_id, time_ms + CASE WHEN eye = 'R' AND sample_id % 4 = 0 THEN 1 ELSE 0 END AS time_ms FROM moving"),
)


def stimulus_frames(spark, sf):
    rec = fx.recording(spark, sf)
    return alignment.with_stimulus(rec.samples, fx.stimuli(rec.samples)).select("session_id", "sample_id", "rel_ms", "stimulus_active")


add(
    "stimulus_frames",
    stimulus_frames,
    query(("samples", "stimuli"), "SELECT session_id, sample_id, frame_ts_ms - onset_ms AS rel_ms, frame_ts_ms BETWEEN onset_ms AND offset_ms AS stimulus_active FROM samples JOIN stimuli USING (session_id)"),
)


def stimulus_interval(spark, sf):
    rec = fx.recording(spark, sf)
    return alignment.during_stimulus(rec.samples, fx.stimuli(rec.samples)).select("session_id", "sample_id", "frame_ts_ms", "onset_ms", "offset_ms")


add(
    "stimulus_interval",
    stimulus_interval,
    query(("samples", "stimuli"), "SELECT s.session_id, sample_id, frame_ts_ms, onset_ms, offset_ms FROM samples s JOIN stimuli t ON s.session_id = t.session_id AND frame_ts_ms BETWEEN onset_ms AND offset_ms"),
)


def stimulus_trains(spark, sf):
    """All frames as one session against intervals of very unlike lengths: from half an hour to 17 hours, one from every 25th event."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    e = fx.table(spark, sf, "events").select(F.lit(1).alias("session_id"), F.col("event_id").alias("sample_id"), t.alias("frame_ts_ms"))
    onset = e.where(F.col("sample_id") % 25 == 0)
    length = F.pow(F.lit(2.0), F.col("sample_id") / 25 % 6) * F.lit(1_800_000.0) + F.col("sample_id") % 7
    trains = onset.select("session_id", F.col("sample_id").alias("train"), F.col("frame_ts_ms").alias("onset_ms"), (F.col("frame_ts_ms") + length).alias("offset_ms"))
    met = alignment.totals_within(e, trains, "session_id", "frame_ts_ms", "onset_ms", "offset_ms", "sample_id", "train")
    return met.select("train", F.col("n").alias("frames"), F.col("least").alias("first"), F.col("most").alias("last"))


cte("clock", (), "SELECT event_id AS sample_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS t FROM events")
add(
    "stimulus_trains",
    stimulus_trains,
    query(
        ("clock",),
        """SELECT i.sample_id AS train, count(*) AS frames, min(c.sample_id) AS first, max(c.sample_id) AS last FROM clock i JOIN clock c
             ON c.t BETWEEN i.t AND i.t + (pow(2e0, i.sample_id / 25 % 6) * 1800000e0 + i.sample_id % 7) WHERE i.sample_id % 25 = 0 GROUP BY 1""",
    ),
)


def _methods(spark, sf):
    rec = fx.recording(spark, sf)
    e = F.col("sample_id")
    a = rec.samples.select(
        "session_id", "sample_id", F.col("frame_ts_ms").alias("ts_ms"), "left_px", "right_px", (F.lit(320) + e % 2).cast("double").alias("center_x"), F.lit(240.0).alias("center_y")
    )
    return rec, a, fx.method_b(rec.samples)


cte("method_a", ("samples",), "SELECT session_id, sample_id, frame_ts_ms AS ts_ms, left_px, right_px, CAST(320 + sample_id % 2 AS DOUBLE) AS center_x, 240e0 AS center_y FROM samples")
cte(
    "compared",
    ("method_a", "method_b"),
    """SELECT *, CASE WHEN lva AND lvb THEN abs(left_px_b - left_px) END AS ld, CASE WHEN rva AND rvb THEN abs(right_px_b - right_px) END AS rd,
       CASE WHEN lva AND lvb THEN dist END AS lc, CASE WHEN rva AND rvb THEN dist END AS rc
       FROM (SELECT a.session_id, a.sample_id, a.ts_ms, left_px, right_px, left_px_b, right_px_b, left_px IS NOT NULL AS lva, right_px IS NOT NULL AS rva,
               left_px_b IS NOT NULL AS lvb, right_px_b IS NOT NULL AS rvb, sqrt((center_x_b - center_x) * (center_x_b - center_x) + (center_y_b - center_y) * (center_y_b - center_y)) AS dist
             FROM method_a a JOIN method_b b ON a.session_id = b.session_id AND a.ts_ms = b.ts_ms)""",
)


def agreement_frames(spark, sf):
    _, a, b = _methods(spark, sf)
    rows = agreement.compare_frames(a, b)
    num = [c for c in rows.columns if c.endswith(("_px", "_pct"))]
    return rows.select("session_id", "sample_id", "agrees", "comparable", *[half_up(F.col(c), 6).alias(c) for c in num])


add(
    "agreement_frames",
    agreement_frames,
    query(
        ("compared",),
        f"""SELECT session_id, sample_id, lva = lvb AND rva = rvb AS agrees, ld IS NOT NULL OR rd IS NOT NULL AS comparable, {r('ld', 6)} AS left_diff_px, {r('lc', 6)} AS left_distance_px,
            {r('ld / left_px * 100e0', 6)} AS left_error_pct, {r('rd', 6)} AS right_diff_px, {r('rc', 6)} AS right_distance_px, {r('rd / right_px * 100e0', 6)} AS right_error_pct,
            {r('(coalesce(ld, 0e0) + coalesce(rd, 0e0)) / nullif((ld IS NOT NULL)::INT + (rd IS NOT NULL)::INT, 0)', 6)} AS mean_diff_px,
            {r('(coalesce(lc, 0e0) + coalesce(rc, 0e0)) / nullif((ld IS NOT NULL)::INT + (rd IS NOT NULL)::INT, 0)', 6)} AS mean_distance_px FROM compared""",
    ),
)
add(
    "agreement_rejects",
    lambda spark, sf: agreement.rejects(*_methods(spark, sf)[1:]).select("session_id", "sample_id", "ts_ms"),
    query(("method_a", "method_b"), "SELECT session_id, sample_id, ts_ms FROM method_b b WHERE NOT EXISTS (SELECT 1 FROM method_a a WHERE a.session_id = b.session_id AND a.ts_ms = b.ts_ms)"),
)


def agreement_stats(spark, sf):
    _, a, b = _methods(spark, sf)
    rows = agreement.statistics(agreement.compare_frames(a, b))
    return rows.select("session_id", "n", "valid_comparisons", *[settle(F.col(c), 4).alias(c) for c in rows.columns[3:]])


_rate = lambda c: s(f"count(*) FILTER ({c}) / count(*)::DOUBLE * 100e0", 4)
add(
    "agreement_stats",
    agreement_stats,
    query(
        ("compared",),
        f"""SELECT k.session_id, n, valid_comparisons, {s("coalesce(list_sum(d) / nullif(len(d), 0), 0e0)", 4)} AS mean_diff_px, {s("coalesce(d[len(d) // 2 + 1], 0e0)", 4)} AS median_diff_px,
            {s("coalesce(list_sum(c) / nullif(len(c), 0), 0e0)", 4)} AS mean_distance_px, {s("coalesce(c[len(c) // 2 + 1], 0e0)", 4)} AS median_distance_px,
            validity_b_pct, validity_a_pct, agreement_pct, {s("coalesce(lm, 0e0)", 4)} AS left_mean_px, {s("coalesce(ls, 0e0)", 4)} AS left_std_px,
            {s("coalesce(ls / nullif(lm, 0) * 100e0, 0e0)", 4)} AS left_cv_pct, {s("coalesce(rm, 0e0)", 4)} AS right_mean_px, {s("coalesce(rs, 0e0)", 4)} AS right_std_px,
            {s("coalesce(rs / nullif(rm, 0) * 100e0, 0e0)", 4)} AS right_cv_pct
        FROM (SELECT session_id, count(*) AS n, count(*) FILTER (ld IS NOT NULL OR rd IS NOT NULL) AS valid_comparisons,
                list_sort(list_filter(list_concat(list(ld), list(rd)), lambda x: x IS NOT NULL)) AS d, list_sort(list_filter(list_concat(list(lc), list(rc)), lambda x: x IS NOT NULL)) AS c,
                {_rate('lvb OR rvb')} AS validity_b_pct, {_rate('lva OR rva')} AS validity_a_pct, {_rate('lva = lvb AND rva = rvb')} AS agreement_pct
              FROM (SELECT * FROM compared QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC) <= 300) GROUP BY 1) k
        LEFT JOIN (SELECT session_id, avg(left_px_b) AS lm, stddev_pop(left_px_b) AS ls FROM (SELECT * FROM compared WHERE left_px_b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC) <= 300) GROUP BY 1) a USING (session_id)
        LEFT JOIN (SELECT session_id, avg(right_px_b) AS rm, stddev_pop(right_px_b) AS rs FROM (SELECT * FROM compared WHERE right_px_b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC) <= 300) GROUP BY 1) b USING (session_id)""",
    ),
)
add(
    "signed_deltas",
    lambda spark, sf: agreement.signed_deltas(*_methods(spark, sf)[1:]),
    query(
        ("compared",),
        f"SELECT session_id, sample_id, {r('left_px_b - left_px', 2)} AS left_delta_px, {r('right_px_b - right_px', 2)} AS right_delta_px, {r('dist', 2)} AS centroid_distance_px FROM compared",
    ),
)


def asof_latest_b(spark, sf):
    rec, a, b = _methods(spark, sf)
    # B is late by up to two frames, so frames of A carry earlier rows of B
    return agreement.latest_before(a, b.withColumn("ts_ms", F.col("ts_ms") + F.col("sample_id") % 3 * 46), rec.heat, ["left_px_b"])


add(
    "asof_latest_b",
    asof_latest_b,
    query(
        ("method_a", "method_b"),
        "SELECT a.session_id, a.sample_id, a.ts_ms, b.sample_id AS b_id, b.left_px_b FROM method_a a ASOF LEFT JOIN (SELECT * REPLACE (ts_ms + sample_id % 3 * 46 AS ts_ms) FROM method_b) b ON a.session_id = b.session_id AND a.ts_ms >= b.ts_ms",
    ),
)


# ---- live operators -------------------------------------------------------------------------------
def _frames(rec):
    return rec.samples.select("session_id", "sample_id", "frame_ts_ms", "left_px", "right_px", F.col("left_px").isNotNull().alias("valid"))


def _apply(spark, sf, fn, prepare=_frames, keys=SES, order=ORDER):
    rec = fx.recording(spark, sf)
    return rec.heat.apply(prepare(rec), keys, order, fn)


cte(
    "isl",
    ("samples",),
    """SELECT *, sum(reset) OVER (PARTITION BY session_id ORDER BY frame_ts_ms) AS island FROM (
         SELECT *, CASE WHEN count(left_px) OVER w = 0 AND count(*) OVER w = 5 THEN 1 ELSE 0 END AS reset FROM samples
         WINDOW w AS (PARTITION BY session_id ORDER BY frame_ts_ms ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
)
add(
    "stability_window",
    lambda spark, sf: _apply(spark, sf, live.stability).select("session_id", "sample_id", "window_count", "left_delta", "right_delta", "state"),
    query(
        ("isl",),
        f"""SELECT session_id, sample_id, CAST(k AS INTEGER) AS window_count, CASE WHEN k >= 6 THEN {r('lx - ln', 2)} ELSE 0e0 END AS left_delta, CASE WHEN k >= 6 THEN {r('rx - rn', 2)} ELSE 0e0 END AS right_delta,
            CASE WHEN k >= 6 AND lx - ln <= 5e-1 AND rx - rn <= 5e-1 THEN 'BASELINE_STABLE' WHEN k > 0 THEN 'COLLECTING_RAW_BASELINE' ELSE 'IDLE' END AS state
        FROM (SELECT a.session_id, a.sample_id, count(b.vn) AS k, max(b.left_px) AS lx, min(b.left_px) AS ln, max(b.right_px) AS rx, min(b.right_px) AS rn
          FROM (SELECT *, count(left_px) OVER (PARTITION BY session_id ORDER BY frame_ts_ms) AS seen FROM isl) a
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms) AS vn FROM isl WHERE left_px IS NOT NULL) b
            ON a.session_id = b.session_id AND a.island = b.island AND b.vn BETWEEN a.seen - 5 AND a.seen GROUP BY 1, 2)""",
    ),
)
add(
    "lost_runs",
    lambda spark, sf: _apply(spark, sf, live.lost_runs).select("session_id", "sample_id", "lost_run", "track_status"),
    query(
        ("samples",),
        """SELECT session_id, sample_id, lost_run, CASE WHEN lost_run = 0 THEN 'DETECTED' WHEN lost_run <= 4 THEN 'UNCERTAIN' ELSE 'LOST' END AS track_status
           FROM (SELECT session_id, sample_id, CASE WHEN left_px IS NOT NULL THEN 0 ELSE row_number() OVER (PARTITION BY session_id, g, left_px IS NULL ORDER BY frame_ts_ms) END AS lost_run
                 FROM (SELECT *, count(left_px) OVER (PARTITION BY session_id ORDER BY frame_ts_ms) AS g FROM samples))""",
    ),
)
STATS = ("min_px", "max_px", "mean_px", "median_px", "range_px", "std_px", "cv_percent")


def _stats_sql(source: str, value: str, by: str) -> str:
    """Statistics of the last 60 valid values, as they stand at each row of the source."""
    figures = zip(STATS, ("mn", "mx", "av", "md", "mx - mn", "sd", "CASE WHEN av > 0 THEN sd / av * 100e0 ELSE 0e0 END"))
    cols = ", ".join(f"CASE WHEN n >= 5 THEN {s(e, 4)} END AS {c}" for c, e in figures)
    last = ", ".join(f"last_value({c} IGNORE NULLS) OVER p AS {c}" for c in ("sample_count", *STATS))
    return f"""SELECT session_id, sample_id, {last} FROM (SELECT session_id, sample_id, {by} FROM {source}) LEFT JOIN (
              SELECT session_id, sample_id, CASE WHEN n >= 5 THEN n END AS sample_count, {cols}
              FROM (SELECT session_id, sample_id, count(*) OVER w AS n, min(v) OVER w AS mn, max(v) OVER w AS mx, avg(v) OVER w AS av, median(v) OVER w AS md, stddev_pop(v) OVER w AS sd
                    FROM (SELECT session_id, sample_id, {by}, {value} AS v FROM {source} WHERE {value} > 0) WINDOW w AS (PARTITION BY session_id ORDER BY {by} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)))
            USING (session_id, sample_id) WINDOW p AS (PARTITION BY session_id ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def rolling_stats60(spark, sf):
    rows = _apply(spark, sf, lambda df, lay: live.rolling_stats(df, lay, "left_px"))
    return rows.select("session_id", "sample_id", "sample_count", *[settle(F.col(c), 4).alias(c) for c in STATS])


add(
    "rolling_stats60",
    rolling_stats60,
    query(
        ("samples",),
        _stats_sql("samples", "left_px", "frame_ts_ms"),
    ),
)
add(
    "rolling20",
    lambda spark, sf: _apply(
        spark, sf, lambda df, lay: live.rolling_mean(df, lay, "latency", 20, "avg_latency"),
        lambda rec: rec.samples.select("session_id", "sample_id", "frame_ts_ms", ((F.col("sample_id") * 37) % 101).cast("double").alias("latency")),
    ).select("session_id", "sample_id", settle(F.col("avg_latency"), 1).alias("avg_latency")),
    query(
        ("samples",),
        f"SELECT session_id, sample_id, {s('avg(CAST((sample_id * 37) % 101 AS DOUBLE)) OVER (PARTITION BY session_id ORDER BY frame_ts_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 1)} AS avg_latency FROM samples",
    ),
)
add(
    "last300",
    lambda spark, sf: live.newest(fx.recording(spark, sf).samples, ["session_id"], [F.col("frame_ts_ms").desc(), F.col("sample_id").desc()], 300).select("session_id", "sample_id", "frame_ts_ms"),
    query(("samples",), "SELECT session_id, sample_id, frame_ts_ms FROM samples QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms DESC, sample_id DESC) <= 300"),
)
_media = lambda: (F.floor(F.col("frame_ts_ms") / 200) * 200).cast("double")
add(
    "frame_dedup",
    lambda spark, sf: _apply(spark, sf, lambda df, lay: live.drop_repeats(df, lay, "media_ms"), lambda rec: rec.samples.select("session_id", "sample_id", "frame_ts_ms", _media().alias("media_ms"))).select(
        "session_id", "sample_id", "media_ms"
    ),
    query(
        ("samples",),
        """SELECT session_id, sample_id, media_ms FROM (SELECT *, lag(media_ms) OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS p
           FROM (SELECT session_id, sample_id, frame_ts_ms, floor(frame_ts_ms / 200) * 200e0 AS media_ms FROM samples)) WHERE p IS NULL OR p <> media_ms""",
    ),
)
cte(
    "ordered",
    ("samples",),
    """SELECT session_id, sample_id, frame_ts_ms, left_px, left_mm, CAST(frame_ts_ms AS BIGINT) - (sample_id % 4) * 120 AS ts,
       row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS rn FROM samples""",
)
_late = lambda: (F.col("frame_ts_ms").cast("long") - (F.col("sample_id") % 4) * 120).alias("ts")
add(
    "monotonic_ts",
    lambda spark, sf: _apply(
        spark, sf, lambda df, lay: live.increasing(df, lay, "ts", "ts_up"), lambda rec: rec.samples.select("session_id", "sample_id", "frame_ts_ms", _late())
    ).select("session_id", "sample_id", "ts", "ts_up"),
    rquery(
        ("ordered",),
        "walk",
        """SELECT session_id, sample_id, rn, ts, ts AS ts_up FROM ordered WHERE rn = 1
           UNION ALL SELECT o.session_id, o.sample_id, o.rn, o.ts, CASE WHEN o.ts > w.ts_up THEN o.ts ELSE w.ts_up + 1 END FROM walk w JOIN ordered o ON o.session_id = w.session_id AND o.rn = w.rn + 1""",
        "SELECT session_id, sample_id, ts, ts_up FROM walk",
    ),
)
cte("found", ("samples",), "SELECT session_id, sample_id, frame_ts_ms, row_number() OVER (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id) AS rn FROM samples WHERE left_px IS NOT NULL")
add(
    "throttle100",
    lambda spark, sf: _apply(spark, sf, lambda df, lay: live.throttle(df, lay, "frame_ts_ms", 100.0), lambda rec: rec.samples.where("left_px is not null").select("session_id", "sample_id", "frame_ts_ms")),
    rquery(
        ("found",),
        "walk",
        """SELECT session_id, sample_id, rn, frame_ts_ms, frame_ts_ms AS last_kept, true AS kept FROM found WHERE rn = 1
           UNION ALL SELECT f.session_id, f.sample_id, f.rn, f.frame_ts_ms, CASE WHEN f.frame_ts_ms - w.last_kept >= 100 THEN f.frame_ts_ms ELSE w.last_kept END, f.frame_ts_ms - w.last_kept >= 100
             FROM walk w JOIN found f ON f.session_id = w.session_id AND f.rn = w.rn + 1""",
        "SELECT session_id, sample_id, frame_ts_ms FROM walk WHERE kept",
    ),
)


def throttle_hot(spark, sf):
    """All frames as one session, cut into days: kept rows are at least six hours apart."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    rows = fx.table(spark, sf, "events").select(F.lit(1).alias("session_id"), F.col("event_id").alias("sample_id"), t.alias("frame_ts_ms"), F.to_date("ts").alias("day"))
    return live.throttle(rows, Layout(SES, ORDER, "day"), "frame_ts_ms", 21_600_000.0).select("sample_id", "frame_ts_ms")


cte("moments", (), "SELECT CAST(epoch_us(ts) // 1000 AS DOUBLE) AS t, min(event_id) AS sample_id FROM events GROUP BY 1")
add(
    "throttle_hot",
    throttle_hot,
    rquery(
        ("moments",),
        "walk",
        """SELECT sample_id, t FROM moments WHERE t = (SELECT min(t) FROM moments)
           UNION ALL SELECT m.sample_id, m.t FROM (SELECT (SELECT min(o.t) FROM moments o WHERE o.t >= w.t + 21600000) AS n FROM walk w) JOIN moments m ON m.t = n""",
        "SELECT sample_id, t AS frame_ts_ms FROM walk",
    ),
)


def _moving_eye(rec):
    e = F.col("sample_id")
    return rec.samples.select(
        "session_id", "sample_id", "frame_ts_ms", F.col("left_px").alias("px"), F.col("left_mm").alias("mm"),
        (F.lit(0.3) + (e % 7).cast("double") * F.lit(0.05)).alias("x"), (F.lit(0.4) + (e % 3).cast("double") * F.lit(0.01)).alias("y"),
    )


def ema_stabilised(spark, sf):
    rows = _apply(spark, sf, live.stabilise, _moving_eye)
    cols = ("smooth_px", "smooth_x", "smooth_y", "smooth_mm")
    return rows.select("session_id", "sample_id", "track_status", "is_jump", *[half_up(F.col(c), 6).alias(c) for c in cols])


cte("moving_eye", ("ordered",), "SELECT *, left_px / 2e0 AS radius, 3e-1 + CAST(sample_id % 7 AS DOUBLE) * 5e-2 AS x, 4e-1 + CAST(sample_id % 3 AS DOUBLE) * 1e-2 AS y, left_mm AS mm FROM ordered")
_jump = "sqrt((o.x - w.x) * (o.x - w.x) + (o.y - w.y) * (o.y - w.y)) > 12e-2"
_a, _b = f"CASE WHEN {_jump} THEN 85e-2 ELSE 65e-2 END", f"CASE WHEN {_jump} THEN (1e0 - 85e-2) ELSE (1e0 - 65e-2) END"
_mix = lambda c: f"CASE WHEN o.left_px IS NULL THEN NULL WHEN w.radius IS NULL THEN o.{c} ELSE ({_a}) * o.{c} + ({_b}) * w.{c} END"
_WALK = f"""SELECT session_id, sample_id, rn, left_px, radius, CASE WHEN left_px IS NOT NULL THEN x END AS x, CASE WHEN left_px IS NOT NULL THEN y END AS y, mm,
              CASE WHEN left_px IS NOT NULL THEN false END AS is_jump, CASE WHEN left_px IS NULL THEN 1 ELSE 0 END AS lost FROM moving_eye WHERE rn = 1
            UNION ALL SELECT o.session_id, o.sample_id, o.rn, o.left_px, {_mix('radius')}, {_mix('x')}, {_mix('y')},
              CASE WHEN o.left_px IS NULL THEN NULL WHEN w.radius IS NULL THEN o.mm ELSE {r(f'({_a}) * o.mm + ({_b}) * w.mm', 2)} END,
              CASE WHEN o.left_px IS NULL THEN NULL WHEN w.radius IS NULL THEN false ELSE {_jump} END, CASE WHEN o.left_px IS NULL THEN w.lost + 1 ELSE 0 END
              FROM walk w JOIN moving_eye o ON o.session_id = w.session_id AND o.rn = w.rn + 1"""
add(
    "ema_stabilised",
    ema_stabilised,
    rquery(
        ("moving_eye",),
        "walk",
        _WALK,
        f"""SELECT session_id, sample_id, CASE WHEN lost = 0 THEN 'DETECTED' WHEN lost <= 4 THEN 'UNCERTAIN' ELSE 'LOST' END AS track_status, is_jump,
            {r('radius * 2e0', 6)} AS smooth_px, {r('x', 6)} AS smooth_x, {r('y', 6)} AS smooth_y, {r('mm', 6)} AS smooth_mm FROM walk""",
    ),
)


def rolling_stats_smoothed(spark, sf):
    """Statistics of the stabilised sizes; lost frames keep the last ones."""
    rows = _apply(spark, sf, lambda df, lay: live.rolling_stats(live.stabilise(df, lay), lay, "smooth_px"), _moving_eye)
    return rows.select("session_id", "sample_id", "sample_count", *[settle(F.col(c), 4).alias(c) for c in STATS])


add("rolling_stats_smoothed", rolling_stats_smoothed, rquery(("moving_eye",), "walk", _WALK, _stats_sql("(SELECT session_id, sample_id, rn, radius * 2e0 AS px FROM walk)", "px", "rn")))
add(
    "raw_jumps",
    lambda spark, sf: _apply(
        spark, sf, live.raw_jumps,
        lambda rec: rec.samples.where("left_px is not null").select(
            "session_id", "sample_id", "frame_ts_ms", (F.col("sample_id") % 7 * F.lit(0.05)).alias("x"), (F.col("sample_id") % 3 * F.lit(0.01)).alias("y")
        ),
    ).select("session_id", "sample_id", "is_jump"),
    query(
        ("samples",),
        """SELECT session_id, sample_id, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) > 12e-2, false) AS is_jump
           FROM (SELECT session_id, sample_id, frame_ts_ms, sample_id % 7 * 5e-2 AS x, sample_id % 3 * 1e-2 AS y FROM samples WHERE left_px IS NOT NULL) WINDOW w AS (PARTITION BY session_id ORDER BY frame_ts_ms, sample_id)""",
    ),
)
