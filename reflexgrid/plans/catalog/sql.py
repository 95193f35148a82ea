"""Shared pieces of the independent SQL checks (DuckDB dialect)."""

from __future__ import annotations


def r(x: str, k: int = 0) -> str:
    """floor(x*10^k + 0.5) / 10^k, written out."""
    return f"floor(({x}) + 5e-1)" if k == 0 else f"(floor(({x}) * 1e{k} + 5e-1) / 1e{k})"


def s(x: str, k: int = 0) -> str:
    """Rounding for sums of floats: to 9 digits first."""
    return r(r(x, 9), k)


def case(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTE[name] = (needs, body)


def query(needs: tuple[str, ...], body: str, recursive: bool = False) -> str:
    """Prefix `body` with the named building blocks in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in CTE[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{blocks}\n{body}"


def rquery(needs: tuple[str, ...], recursive_name: str, recursive_body: str, body: str) -> str:
    """Like `query`, with one recursive block at the end."""
    base = query(needs, "", recursive=True).rstrip()
    head = base if base else "WITH RECURSIVE"
    sep = ",\n" if base else " "
    return f"{head}{sep}{recursive_name} AS ({recursive_body})\n{body}"


cte("evs", (), "SELECT user_id AS session_id, event_id AS sample_id, ts, event_type, user_id % 5 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
cte(
    "shape",
    ("evs",),
    """SELECT *, CAST(80 * (rn - 1) + 5 * (sample_id % 7) AS DOUBLE) - 1500e0 AS time_ms,
       4e0 + 1e-1 * CAST(session_id % 7 AS DOUBLE) AS bl,
       CASE c WHEN 1 THEN 45e-2 WHEN 2 THEN 5e-2 ELSE 14e-1 END AS al,
       CAST((sample_id % 11) - 5 AS DOUBLE) * 4e-3 * CASE WHEN c = 4 THEN 15e0 ELSE 1e0 END AS nz FROM evs""",
)
cte(
    "ramped",
    ("shape",),
    """SELECT *, bl - CASE WHEN c = 3 THEN 12e-1 ELSE 5e-2 END AS br, CASE WHEN c = 3 THEN 2e-1 ELSE al * 96e-2 END AS ar,
       CASE WHEN time_ms <= 220 THEN 0e0 WHEN time_ms <= 1100 THEN (time_ms - 220e0) / 880e0
            ELSE 1e0 - 4e-1 * least(1e0, (time_ms - 1100e0) / 2500e0) END AS ramp FROM shape""",
)
cte(
    "samples",
    ("ramped",),
    f"""SELECT session_id, sample_id, ts, event_type, time_ms, time_ms + 1500e0 AS frame_ts_ms,
       CASE WHEN event_type <> 'error' THEN {r('bl - al * ramp + nz', 3)} END AS left_mm,
       CASE WHEN event_type <> 'error' THEN {r('br - ar * ramp + nz', 3)} END AS right_mm,
       CASE WHEN event_type <> 'error' THEN {r('bl - al * ramp + nz', 3)} * 20e0 END AS left_px,
       CASE WHEN event_type <> 'error' THEN {r('br - ar * ramp + nz', 3)} * 20e0 END AS right_px,
       CASE WHEN event_type = 'error' OR c = 4 THEN 20e0 WHEN event_type = 'signup' THEN 65e0 ELSE 95e0 END AS confidence,
       CASE WHEN event_type = 'error' OR c = 4 THEN 'LOST' WHEN event_type = 'signup' THEN 'DEGRADED' ELSE 'GOOD' END AS status
       FROM ramped""",
)
cte(
    "eyes",
    ("samples",),
    """SELECT session_id, 'L' AS eye, time_ms, sample_id, left_mm AS raw_mm, confidence FROM samples
       UNION ALL SELECT session_id, 'R', time_ms, sample_id, right_mm, confidence FROM samples""",
)
W = "OVER (PARTITION BY session_id, eye ORDER BY time_ms, sample_id"
cte(
    "flagged",
    ("eyes",),
    "SELECT *, coalesce(raw_mm BETWEEN 1e0 AND 95e-1 AND confidence >= 20, false) AS ok FROM eyes",
)
cte(
    "around",
    ("flagged",),
    f"""SELECT *,
       last_value(CASE WHEN ok THEN time_ms END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
       last_value(CASE WHEN ok THEN raw_mm END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
       last_value(CASE WHEN ok THEN confidence END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
       first_value(CASE WHEN ok THEN time_ms END IGNORE NULLS) {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt,
       first_value(CASE WHEN ok THEN raw_mm END IGNORE NULLS) {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv,
       first_value(CASE WHEN ok THEN confidence END IGNORE NULLS) {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc
       FROM flagged""",
)
cte(
    "repaired",
    ("around",),
    """SELECT session_id, eye, time_ms, sample_id, raw_mm, confidence, false AS is_interpolated FROM around WHERE ok
       UNION ALL SELECT session_id, eye, time_ms, sample_id, pv + (time_ms - pt) / (nt - pt) * (nv - pv), greatest(10e0, least(pc, nc) * 7e-1), true
         FROM around WHERE NOT ok AND pt IS NOT NULL AND nt IS NOT NULL AND nt - pt <= 350
       UNION ALL SELECT session_id, eye, time_ms, sample_id, pv, pc * 5e-1, true FROM around WHERE NOT ok AND pt IS NOT NULL AND nt IS NULL AND time_ms - pt <= 100
       UNION ALL SELECT session_id, eye, time_ms, sample_id, nv, nc * 5e-1, true FROM around WHERE NOT ok AND pt IS NULL AND nt IS NOT NULL AND nt - time_ms <= 100""",
)
G1, G2 = "0.6065306597126334::DOUBLE", "0.1353352832366127::DOUBLE"


def taps(value: str = "raw_mm", order: str = W) -> str:
    cols = [f"lag({value}, {k}) {order}) AS a{k}, lead({value}, {k}) {order}) AS b{k}" for k in (1, 2, 3)]
    return ", ".join(cols)


EDGE = (
    f"(coalesce(a2 * {G2}, 0e0) + coalesce(a1 * {G1}, 0e0) + raw_mm + coalesce(b1 * {G1}, 0e0) + coalesce(b2 * {G2}, 0e0))"
    f" / (CASE WHEN a2 IS NULL THEN 0e0 ELSE {G2} END + CASE WHEN a1 IS NULL THEN 0e0 ELSE {G1} END + 1e0"
    f" + CASE WHEN b1 IS NULL THEN 0e0 ELSE {G1} END + CASE WHEN b2 IS NULL THEN 0e0 ELSE {G2} END)"
)
SHORT = "(coalesce(a1, 0e0) + raw_mm * 2e0 + coalesce(b1, 0e0)) / (CASE WHEN a1 IS NULL THEN 0e0 ELSE 1e0 END + 2e0 + CASE WHEN b1 IS NULL THEN 0e0 ELSE 1e0 END)"
FIVE = f"CASE WHEN a2 IS NOT NULL AND b2 IS NOT NULL THEN (a2 * -3e0 + a1 * 12e0 + raw_mm * 17e0 + b1 * 12e0 + b2 * -3e0) / 35e0 ELSE {EDGE} END"
cte("tapped", ("repaired",), f"SELECT *, count(*) OVER (PARTITION BY session_id, eye) AS n, {taps()} FROM repaired")
cte(
    "smoothed",
    ("tapped",),
    f"SELECT session_id, eye, time_ms, sample_id, raw_mm, confidence, is_interpolated, n, CASE WHEN n < 3 THEN raw_mm WHEN n < 5 THEN {SHORT} ELSE {FIVE} END AS clean_mm FROM tapped",
)


def slope_sql(source: str, value: str, out: str) -> str:
    """Velocity of `value`; times are strictly increasing in the data, so no zero step occurs."""
    return f"""SELECT * EXCLUDE (pv_, pt_, nv_, nt_), CASE
         WHEN pt_ IS NULL AND nt_ IS NULL THEN 0e0
         WHEN pt_ IS NULL THEN (nv_ - {value}) / ((nt_ - time_ms) / 1000e0)
         WHEN nt_ IS NULL THEN ({value} - pv_) / ((time_ms - pt_) / 1000e0)
         ELSE (nv_ - pv_) / ((nt_ - pt_) / 1000e0) END AS {out}
       FROM (SELECT *, lag({value}) {W}) AS pv_, lag(time_ms) {W}) AS pt_, lead({value}) {W}) AS nv_, lead(time_ms) {W}) AS nt_ FROM {source})"""


cte("moving", ("smoothed",), slope_sql("smoothed", "clean_mm", "velocity"))
cte("series", ("moving",), f"SELECT *, row_number() {W}) AS idx FROM moving")
cte(
    "stats0",
    ("series",),
    """SELECT session_id, eye, count(*) AS points, avg(confidence) AS mean_conf,
       coalesce(avg(clean_mm) FILTER (time_ms <= 0), max(clean_mm) FILTER (idx = 1)) AS base_raw,
       coalesce(stddev_pop(clean_mm) FILTER (time_ms <= 0), 5e-2) AS sigma_raw
       FROM series GROUP BY ALL""",
)
cte("stats1", ("stats0",), f"SELECT session_id, eye, points, mean_conf, {r('base_raw', 9)} AS baseline, {r('sigma_raw', 9)} AS sigma FROM stats0")
cte(
    "lows",
    ("series", "stats1"),
    """SELECT session_id, eye, time_ms, clean_mm, idx, time_ms BETWEEN 100 AND 2500 AS near,
       row_number() OVER (PARTITION BY session_id, eye ORDER BY (time_ms BETWEEN 100 AND 2500) DESC, clean_mm, idx) AS rk
       FROM series JOIN stats1 USING (session_id, eye) WHERE clean_mm < baseline AND (time_ms > 0)""",
)
cte(
    "stats",
    ("stats1", "lows"),
    """SELECT s.*, coalesce(l.clean_mm, baseline) AS nadir, l.idx AS nadir_idx, l.time_ms AS nadir_ms,
       greatest(0e0, baseline - coalesce(l.clean_mm, baseline)) AS amplitude
       FROM stats1 s LEFT JOIN (SELECT * FROM lows WHERE rk = 1) l USING (session_id, eye)""",
)
cte(
    "moved",
    ("series", "stats"),
    """SELECT session_id, eye, min(time_ms) AS moved_ms FROM series JOIN stats USING (session_id, eye)
       WHERE time_ms BETWEEN 140 AND 750 AND velocity <= least(-18e-2, -2e0 * greatest(4e-2, sigma * 5e0))
         AND clean_mm <= baseline - greatest(4e-2, sigma * 15e-1) GROUP BY ALL""",
)
cte(
    "peaks",
    ("series", "stats"),
    """SELECT session_id, eye, -velocity AS speed, time_ms AS peak_ms, clean_mm AS peak_mm FROM series JOIN stats USING (session_id, eye)
       WHERE time_ms >= 100 AND velocity < 0 AND (nadir_idx IS NULL OR idx <= nadir_idx + 2)
       QUALIFY row_number() OVER (PARTITION BY session_id, eye ORDER BY velocity, idx) = 1""",
)
cte(
    "backs",
    ("series", "stats"),
    """SELECT session_id, eye, min(time_ms) AS back_ms FROM series JOIN stats USING (session_id, eye)
       WHERE amplitude >= 3e-1 AND idx >= nadir_idx AND clean_mm >= nadir + amplitude * 75e-2 GROUP BY ALL""",
)
cte(
    "timed",
    ("stats", "moved", "peaks", "backs"),
    f"""SELECT *, coalesce(speed, 0e0) AS peak_speed, {r('coalesce(moved_ms, 220e0)')} AS start_ms,
       {r('peak_ms - (peak_mm - baseline) / (-speed)', 9)} AS cross_ms, back_ms - nadir_ms AS recovery_ms
       FROM stats LEFT JOIN moved USING (session_id, eye) LEFT JOIN peaks USING (session_id, eye) LEFT JOIN backs USING (session_id, eye)""",
)
cte(
    "features",
    ("timed",),
    f"""SELECT *, CASE WHEN coalesce(peak_speed >= 1 AND amplitude >= 3e-1 AND cross_ms BETWEEN 150 AND 600, false)
       THEN {r('CASE WHEN moved_ms IS NULL THEN cross_ms ELSE least(start_ms, cross_ms) END')} ELSE start_ms END AS latency_ms FROM timed""",
)
cte(
    "base_px",
    ("samples",),
    """SELECT session_id, eye, arg_max(px, (frame_ts_ms, sample_id)) AS base_px FROM (
         SELECT session_id, 'L' AS eye, left_px AS px, frame_ts_ms, sample_id FROM samples WHERE time_ms < 0
         UNION ALL SELECT session_id, 'R', right_px, frame_ts_ms, sample_id FROM samples WHERE time_ms < 0)
       WHERE px IS NOT NULL AND px <> 0 GROUP BY ALL""",
)
cte(
    "scored",
    ("eyes", "features", "base_px"),
    f"""SELECT *, coalesce(points, 0) >= 5 AS enough, {r('CASE WHEN baseline > 0 THEN amplitude / baseline * 100e0 ELSE 0e0 END', 9)} AS pct, {s('peak_speed', 2)} AS mcv,
       greatest(0e0, coalesce(nadir_ms, 0e0)) AS to_min,
       {s('mean_conf * 6e-1 + greatest(0e0, least(100e0, ' + r('100e0 - sigma * 200e0') + ')) * 4e-1')} AS quality,
       coalesce(base_px, baseline * 20e0) AS b_px
       FROM (SELECT DISTINCT session_id, eye FROM eyes) LEFT JOIN features USING (session_id, eye) LEFT JOIN base_px USING (session_id, eye)""",
)
cte(
    "metrics",
    ("scored",),
    f"""SELECT session_id, eye,
       CASE WHEN enough THEN {s('baseline', 2)} ELSE 0e0 END AS baseline_mm,
       CASE WHEN enough THEN {s('b_px', 1)} ELSE coalesce(base_px, 0e0) END AS baseline_px,
       CASE WHEN enough THEN {s('nadir', 2)} ELSE 0e0 END AS min_mm,
       CASE WHEN enough THEN {s('b_px * (1e0 - pct / 100e0)', 1)} ELSE 0e0 END AS min_px,
       CASE WHEN enough THEN {s('amplitude', 2)} ELSE 0e0 END AS amplitude_mm,
       CASE WHEN enough THEN {s('pct', 1)} ELSE 0e0 END AS constriction_pct,
       CASE WHEN enough THEN latency_ms ELSE 0e0 END AS latency_ms,
       CASE WHEN enough THEN mcv ELSE 0e0 END AS mcv_mm_s,
       CASE WHEN enough THEN {r('to_min')} ELSE 0e0 END AS time_to_min_ms,
       CASE WHEN enough THEN {s('amplitude / greatest(5e-2, (to_min - latency_ms) / 1000e0)', 2)} ELSE 0e0 END AS mean_velocity_mm_s,
       CASE WHEN enough THEN {r('recovery_ms')} END AS recovery75_ms,
       CASE WHEN enough THEN quality ELSE 0e0 END AS quality_score, coalesce(points, 0) AS kept_points,
       CASE WHEN NOT enough OR quality < 40 THEN 'INCONCLUSIVE' WHEN amplitude < 2e-1 OR pct < 5 THEN 'NON_REACTIVE_FIXED'
            WHEN pct < 14 OR mcv < 14e-1 OR latency_ms > 380 THEN 'SLUGGISH_REDUCED' ELSE 'NORMAL_REACTIVE' END AS response_pattern
       FROM scored""",
)
_pair = ", ".join(
    f"l.{c} AS left_{c}, r.{c} AS right_{c}"
    for c in (
        "baseline_mm", "baseline_px", "min_mm", "min_px", "amplitude_mm", "constriction_pct", "latency_ms", "mcv_mm_s",
        "time_to_min_ms", "mean_velocity_mm_s", "recovery75_ms", "quality_score", "response_pattern",
    )
)
_gaps = ", ".join(
    f"{s(f'abs(left_{c} - right_{c})', k)} AS {n}"
    for c, k, n in (
        ("baseline_mm", 2, "baseline_anisocoria_mm"), ("min_mm", 2, "min_anisocoria_mm"), ("constriction_pct", 1, "constriction_pct_diff"),
        ("amplitude_mm", 2, "amplitude_diff_mm"), ("latency_ms", 0, "latency_diff_ms"), ("mcv_mm_s", 2, "mcv_diff_mm_s"),
    )
)
cte("pairs", ("metrics",), f"SELECT l.session_id, {_pair} FROM metrics l JOIN metrics r ON l.session_id = r.session_id AND l.eye = 'L' AND r.eye = 'R'")
cte("gaps", ("pairs",), f"SELECT *, {_gaps} FROM pairs")
cte(
    "asym",
    ("gaps",),
    """SELECT *, CASE WHEN baseline_anisocoria_mm >= 1 OR constriction_pct_diff >= 16 OR latency_diff_ms > 120 THEN 'MARKED_ASYMMETRY'
         WHEN baseline_anisocoria_mm >= 4e-1 OR constriction_pct_diff >= 8 OR latency_diff_ms > 60 THEN 'MILD_ASYMMETRY' ELSE 'SYMMETRIC' END AS asymmetry_severity
       FROM gaps""",
)
cte(
    "summary",
    ("samples", "repaired"),
    f"""SELECT session_id, frames, duration_ms, CASE WHEN duration_ms > 0 THEN {r('frames * 1000e0 / duration_ms')} ELSE 0e0 END AS average_fps,
       {s('kept / (frames * 2)', 4)} AS valid_ratio, {s('conf', 2)} AS mean_confidence,
       {s('greatest(0e0, least(100e0, kept / (frames * 2) * 50e0 + conf * 5e-1))')} AS recording_quality
       FROM (SELECT session_id, count(*) AS frames, max(frame_ts_ms) - min(frame_ts_ms) AS duration_ms, avg(confidence) AS conf FROM samples GROUP BY 1)
       JOIN (SELECT session_id, count(r.sample_id)::DOUBLE AS kept FROM (SELECT DISTINCT session_id FROM samples) LEFT JOIN repaired r USING (session_id) GROUP BY 1) USING (session_id)""",
)
cte(
    "report",
    ("asym", "summary"),
    f"""SELECT *, overall_quality >= 60 AND left_response_pattern <> 'INCONCLUSIVE' AND right_response_pattern <> 'INCONCLUSIVE' AS is_reliable
       FROM (SELECT *, {r('(left_quality_score + right_quality_score + recording_quality) / 3e0')} AS overall_quality FROM asym JOIN summary USING (session_id))""",
)
cte(
    "stimuli",
    ("samples",),
    "SELECT DISTINCT session_id, 1500e0 AS onset_ms, 1700e0 AS offset_ms, 200e0 AS configured_ms, 200e0 AS actual_ms FROM samples",
)
cte(
    "method_b",
    ("samples",),
    """SELECT session_id, sample_id, frame_ts_ms + CASE WHEN sample_id % 9 = 0 THEN 1e0 ELSE 0e0 END AS ts_ms,
       CASE WHEN sample_id % 13 <> 0 THEN left_px + CAST(sample_id % 5 - 2 AS DOUBLE) * 5e-1 END AS left_px_b,
       CASE WHEN sample_id % 13 <> 0 THEN right_px + CAST(sample_id % 5 - 2 AS DOUBLE) * 5e-1 END AS right_px_b,
       CAST(320 + sample_id % 4 AS DOUBLE) AS center_x_b, CAST(240 + sample_id % 3 AS DOUBLE) AS center_y_b FROM samples""",
)
_mech = "['SPORTS_COLLISION','FALL_ELEVATION','MOTOR_VEHICLE_ACCIDENT','BLAST_PRESSURE_WAVE','BLUNT_ASSAULT','ROUTINE_BASELINE_SCREEN','OTHER_UNKNOWN']"
_since = "['LESS_THAN_30_MIN','THIRTY_TO_120_MIN','TWO_TO_SIX_HOURS','SIX_TO_24_HOURS','GREATER_THAN_24_HOURS','NOT_APPLICABLE']"
cte(
    "contexts",
    (),
    f"""SELECT u AS session_id, 'P-' || u AS patient_id, CAST(u % 80 + 10 AS INTEGER) AS age_years, {_mech}[u % 7 + 1] AS mechanism, {_since}[u % 6 + 1] AS time_elapsed,
       CASE u % 6 WHEN 1 THEN ['DIZZINESS_VERTIGO'] WHEN 3 THEN ['REPEATED_VOMITING','SEIZURE_CONVULSION'] WHEN 5 THEN ['NECK_PAIN_SPINAL_TENDERNESS'] ELSE [] END AS symptoms,
       u % 10 = 3 AS known_anisocoria
       FROM (SELECT DISTINCT user_id AS u FROM events UNION ALL SELECT DISTINCT user_id + 1000000 FROM events WHERE user_id % 10 = 0)""",
)
cte(
    "vecs",
    (),
    """SELECT CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, vec_id AS sample, CAST(label AS VARCHAR) AS subject, embedding AS v, -1 AS flip FROM embeddings
       UNION ALL SELECT 'val', vec_id + 1000000, CAST(label AS VARCHAR), embedding, vec_id % 64 FROM embeddings WHERE vec_id % 25 = 1
       UNION ALL SELECT 'val', vec_id + 2000000, CAST(label AS VARCHAR), embedding, -1 FROM embeddings WHERE vec_id % 25 = 6""",
)
cte(
    "thumbs",
    ("vecs",),
    """SELECT split, sample, subject, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
       floor((CASE WHEN i = flip THEN -1e0 ELSE 1e0 END) * CAST(v[i + 1] AS DOUBLE) * 1000e0 + 5e-1) AS lum FROM vecs, range(64) t(i)""",
)
cte(
    "masks",
    ("thumbs",),
    "SELECT split, sample, y, x, CASE WHEN lum > 20 THEN 2 WHEN lum > -50 THEN 3 WHEN lum > -120 THEN 1 ELSE 0 END AS class FROM thumbs",
)
cte(
    "pred_masks",
    ("thumbs",),
    "SELECT split, sample, y, x, CASE WHEN lum > 30 THEN 2 WHEN lum > -40 THEN 3 WHEN lum > -110 THEN 1 ELSE 0 END AS class FROM thumbs",
)
cte(
    "logits",
    (),
    """SELECT vec_id AS sample, CAST(i // 16 AS INTEGER) AS y, CAST((i // 4) % 4 AS INTEGER) AS x, CAST(i % 4 AS INTEGER) AS class,
       CAST(embedding[i + 1] AS DOUBLE) AS logit FROM embeddings, range(64) t(i)""",
)
