"""Queries on triage rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import triage as tr
from .. import fixtures as fx
from .registry import add
from .sql import cte, query


def assessed(spark, sf):
    return tr.triage(fx.contexts(spark, sf), fx.recording(spark, sf).report())


_FIXED = "(({s}_response_pattern = 'NON_REACTIVE_FIXED') OR {s}_constriction_pct < 5)"
_SLOW = "(({s}_response_pattern = 'SLUGGISH_REDUCED') OR ({s}_mcv_mm_s < 15e-1 AND {s}_mcv_mm_s > 0))"
cte(
    "joined",
    ("contexts", "report"),
    f"""SELECT c.*, r.* EXCLUDE (session_id), r.session_id IS NOT NULL AS has_report, {_FIXED.format(s='left')} AS lf, {_FIXED.format(s='right')} AS rf,
        {_SLOW.format(s='left')} AS ls, {_SLOW.format(s='right')} AS rs FROM contexts c LEFT JOIN report r USING (session_id)""",
)
_symptoms = " UNION ALL ".join(
    f"SELECT session_id, {i} AS ord, 'SYM_{sid}' AS id, 'Red Flag Symptom: {label}' AS title, 'SYMPTOM' AS category, 'CRITICAL' AS severity, '{text}' AS description FROM joined WHERE list_contains(symptoms, '{sid}')"
    for i, (sid, label, text) in enumerate(
        [
            ("LOSS_OF_CONSCIOUSNESS", "Loss of Consciousness (LOC)", "Witnessed or reported transient or prolonged unconsciousness following impact."),
            ("REPEATED_VOMITING", "Repeated Vomiting (≥ 2 episodes)", "Two or more vomiting episodes, indicating elevated intracranial pressure (ICP)."),
            ("SEVERE_WORSENING_HEADACHE", "Progressively Worsening Headache", "Severe, escalating headache unresponsive to mild analgesics."),
            ("SEIZURE_CONVULSION", "Seizure or Post-Impact Convulsion", "Any tonic-clonic posturing, twitching, or witnessed seizure activity."),
            ("FOCAL_NEURO_DEFICIT", "Focal Neurological Deficit / Weakness", "Unilateral limb weakness, facial droop, numbness, or slurred speech."),
            ("NECK_PAIN_SPINAL_TENDERNESS", "Cervical Spine Pain / Midline Tenderness", "Pain along the cervical spine, tingling in extremities, or numbness."),
        ]
    )
)


def _rule(order: int, rid: str, where: str, severity: str, title: str, text: str) -> str:
    return f"SELECT session_id, {order} AS ord, '{rid}' AS id, {title} AS title, 'PUPILLOMETRY' AS category, '{severity}' AS severity, {text} AS description FROM joined WHERE has_report AND ({where})"


_rules = [
    _rule(10, "PLR_LOW_QUALITY", "NOT is_reliable OR left_quality_score < 40 OR right_quality_score < 40", "WARNING", "'Degraded Signal / Low Tracking Quality'",
          "printf('Tracking reliability score (L: %d%%, R: %d%%) is below acceptable clinical threshold.', left_quality_score::BIGINT, right_quality_score::BIGINT)"),
    _rule(11, "PLR_SEVERE_ANISOCORIA", "baseline_anisocoria_mm >= 1", "CRITICAL", "printf('Severe Baseline Anisocoria (Δ %.2f mm)', baseline_anisocoria_mm)",
          "printf('Inter-eye baseline diameter difference of %.2f mm exceeds the 1.0 mm acute emergency threshold.', baseline_anisocoria_mm)"),
    _rule(12, "PLR_MODERATE_ANISOCORIA", "baseline_anisocoria_mm < 1 AND baseline_anisocoria_mm >= 4e-1 AND NOT known_anisocoria", "WARNING",
          "printf('Physiological/Moderate Anisocoria (Δ %.2f mm)', baseline_anisocoria_mm)", "printf('Baseline pupil asymmetry of %.2f mm is clinically noteworthy.', baseline_anisocoria_mm)"),
    _rule(13, "PLR_BILATERAL_FIXED", "lf AND rf", "CRITICAL", "'Bilateral Fixed / Non-Reactive Pupils'",
          "printf('Both left (%.1f%%) and right (%.1f%%) pupils demonstrate negligible constriction to light stimulus.', left_constriction_pct, right_constriction_pct)"),
    _rule(14, "PLR_UNILATERAL_FIXED", "lf <> rf", "CRITICAL", "printf('Unilateral Fixed Non-Reactive Pupil (%s Eye)', CASE WHEN lf THEN 'Left' ELSE 'Right' END)",
          "printf('%s pupil is non-reactive (<5%% constriction) while %s eye retains reactivity.', CASE WHEN lf THEN 'Left' ELSE 'Right' END, CASE WHEN lf THEN 'Right' ELSE 'Left' END)"),
    _rule(15, "PLR_SLUGGISH_RESPONSE", "(ls OR rs) AND NOT lf AND NOT rf", "WARNING", "'Sluggish Pupillary Constriction Dynamics'",
          "printf('Constriction velocity (L: %.2f mm/s, R: %.2f mm/s) or amplitude is significantly reduced.', left_mcv_mm_s, right_mcv_mm_s)"),
    _rule(16, "PLR_DELAYED_LATENCY", "left_latency_ms > 320 OR right_latency_ms > 320", "WARNING",
          "printf('Delayed Pupillary Latency (L: %d ms, R: %d ms)', left_latency_ms::BIGINT, right_latency_ms::BIGINT)", "'Reflex latency exceeds standard clinical threshold (normal range: 200–300 ms).'"),
    _rule(17, "PLR_MARKED_ASYMMETRY", "asymmetry_severity = 'MARKED_ASYMMETRY'", "WARNING", "'Marked Dynamic Bilateral Asymmetry'",
          "printf('Latency difference is %d ms; MCV difference is %.2f mm/s.', latency_diff_ms::BIGINT, mcv_diff_mm_s)"),
]
cte("fired", ("joined",), _symptoms + " UNION ALL " + " UNION ALL ".join(_rules))
cte(
    "urgency",
    ("joined", "fired"),
    """SELECT *, CASE WHEN n_critical > 0 THEN 'EMERGENCY_RED' WHEN n_warning > 0 AND NOT low THEN 'OBSERVE_AMBER' WHEN low THEN 'INCONCLUSIVE_GRAY' ELSE 'NORMAL_GREEN' END AS urgency
       FROM joined LEFT JOIN (SELECT session_id, count(*) FILTER (severity = 'CRITICAL') AS nc, count(*) FILTER (severity = 'WARNING') AS nw, bool_or(id = 'PLR_LOW_QUALITY') AS lw FROM fired GROUP BY 1) f USING (session_id),
       LATERAL (SELECT CAST(coalesce(nc, 0) AS INTEGER) AS n_critical, CAST(coalesce(nw, 0) AS INTEGER) AS n_warning, coalesce(lw, false) AS low)""",
)
_lines = " ".join(f"WHEN '{k}' THEN [{', '.join(chr(39) + t + chr(39) for t in v)}]" for k, v in tr.DIRECTIVES.items())
_heads = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tr.HEADLINES.items())
cte(
    "assessed",
    ("urgency",),
    f"""SELECT *, CASE urgency {_heads} END AS headline,
        CASE urgency WHEN 'EMERGENCY_RED' THEN printf('Urgent clinical alerts triggered (%d critical finding%s). High risk of acute traumatic brain injury or elevated intracranial pressure.', n_critical, CASE WHEN n_critical > 1 THEN 's' ELSE '' END)
          WHEN 'OBSERVE_AMBER' THEN printf('Sluggish constriction velocity, latency prolongation, or moderate symptom markers observed (%d warning findings). Concussion / mTBI protocol recommended.', n_warning)
          WHEN 'INCONCLUSIVE_GRAY' THEN '{tr.GRAY_SUMMARY}' ELSE '{tr.GREEN_SUMMARY}' END AS summary,
        array_to_string(list_concat(CASE WHEN list_contains(symptoms, 'NECK_PAIN_SPINAL_TENDERNESS') THEN ['{tr.SPINAL}'] ELSE [] END, CASE urgency {_lines} END), chr(10)) AS directives FROM urgency""",
)

add(
    "symptom_join",
    lambda spark, sf: tr.symptom_rows(fx.contexts(spark, sf)).groupBy("symptom", "category", "is_red_flag").agg(F.count(F.lit(1)).alias("patients")),
    query(
        ("contexts",),
        """SELECT symptom, CASE symptom WHEN 'DIZZINESS_VERTIGO' THEN 'GENERAL_CONCUSSION' ELSE 'CRITICAL_RED_FLAG' END AS category, symptom <> 'DIZZINESS_VERTIGO' AS is_red_flag, count(*) AS patients
           FROM (SELECT unnest(symptoms) AS symptom FROM contexts) GROUP BY ALL""",
    ),
)
add(
    "context_report",
    lambda spark, sf: tr.with_reports(fx.contexts(spark, sf), fx.recording(spark, sf).report()).select("session_id", "mechanism", "has_report", "overall_quality"),
    query(("joined",), "SELECT session_id, mechanism, has_report, overall_quality FROM joined"),
)
add(
    "triage_triggers",
    lambda spark, sf: tr.trigger_rows(assessed(spark, sf)).select("session_id", "pos", "id", "title", "category", "severity", "description"),
    query(("fired",), "SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS INTEGER) AS pos, id, title, category, severity, description FROM fired"),
)
add(
    "triage_urgency",
    lambda spark, sf: assessed(spark, sf).select(
        "session_id", "urgency", "headline", "summary", F.concat_ws("\n", "directives").alias("directives"), "needs_transport", "needs_suspension"
    ),
    query(
        ("assessed",),
        "SELECT session_id, urgency, headline, summary, directives, urgency = 'EMERGENCY_RED' AS needs_transport, urgency IN ('EMERGENCY_RED', 'OBSERVE_AMBER') AS needs_suspension FROM assessed",
    ),
)
add(
    "triage_pupillometry",
    lambda spark, sf: assessed(spark, sf).select("session_id", "pupillometry.*"),
    query(
        ("joined",),
        """SELECT session_id, left_response_pattern AS left_pattern, right_response_pattern AS right_pattern, baseline_anisocoria_mm AS anisocoria_mm, left_mcv_mm_s AS mcv_left,
           right_mcv_mm_s AS mcv_right, left_latency_ms AS latency_left_ms, right_latency_ms AS latency_right_ms FROM joined""",
    ),
)
add(
    "trigger_counts",
    lambda spark, sf: assessed(spark, sf).select("session_id", "n_critical", "n_warning"),
    query(("urgency",), "SELECT session_id, n_critical, n_warning FROM urgency"),
)
add(
    "triage_cube",
    lambda spark, sf: tr.population_cube(assessed(spark, sf)),
    query(
        ("urgency",),
        "SELECT urgency, mechanism, time_elapsed, CAST(grouping(urgency, mechanism, time_elapsed) AS BIGINT) AS level, count(*) AS patients FROM urgency GROUP BY CUBE (urgency, mechanism, time_elapsed)",
    ),
)
