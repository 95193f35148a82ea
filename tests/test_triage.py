"""One case per rule."""

import pytest
from pyspark.sql import functions as F

from reflexgrid.config import TriageSettings
from reflexgrid.operators import triage as tr

NORMAL = dict(
    left_response_pattern="NORMAL_REACTIVE", right_response_pattern="NORMAL_REACTIVE", left_constriction_pct=35.0, right_constriction_pct=34.0, left_mcv_mm_s=3.2, right_mcv_mm_s=3.1,
    left_latency_ms=230.0, right_latency_ms=235.0, left_quality_score=90.0, right_quality_score=90.0, baseline_anisocoria_mm=0.1, asymmetry_severity="SYMMETRIC", latency_diff_ms=5.0,
    mcv_diff_mm_s=0.1, is_reliable=True,
)
CASES = {
    "normal": ({}, [], False, "NORMAL_GREEN", []),
    "severe": ({"baseline_anisocoria_mm": 1.0}, [], False, "EMERGENCY_RED", ["PLR_SEVERE_ANISOCORIA"]),
    "moderate": ({"baseline_anisocoria_mm": 0.4}, [], False, "OBSERVE_AMBER", ["PLR_MODERATE_ANISOCORIA"]),
    "known": ({"baseline_anisocoria_mm": 0.6}, [], True, "NORMAL_GREEN", []),
    "both_fixed": ({"left_response_pattern": "NON_REACTIVE_FIXED", "right_constriction_pct": 4.9}, [], False, "EMERGENCY_RED", ["PLR_BILATERAL_FIXED"]),
    "one_fixed": ({"left_response_pattern": "NON_REACTIVE_FIXED"}, [], False, "EMERGENCY_RED", ["PLR_UNILATERAL_FIXED"]),
    "symptom": ({}, ["LOSS_OF_CONSCIOUSNESS"], False, "EMERGENCY_RED", ["SYM_LOSS_OF_CONSCIOUSNESS"]),
    "spine": ({}, ["NECK_PAIN_SPINAL_TENDERNESS"], False, "EMERGENCY_RED", ["SYM_NECK_PAIN_SPINAL_TENDERNESS"]),
    "no_flag": ({}, ["DIZZINESS_VERTIGO"], False, "NORMAL_GREEN", []),
    "sluggish": ({"left_mcv_mm_s": 1.4}, [], False, "OBSERVE_AMBER", ["PLR_SLUGGISH_RESPONSE"]),
    "latency": ({"right_latency_ms": 321.0}, [], False, "OBSERVE_AMBER", ["PLR_DELAYED_LATENCY"]),
    "quality": ({"is_reliable": False}, [], False, "INCONCLUSIVE_GRAY", ["PLR_LOW_QUALITY"]),
    "marked": ({"asymmetry_severity": "MARKED_ASYMMETRY"}, [], False, "OBSERVE_AMBER", ["PLR_MARKED_ASYMMETRY"]),
    "order": ({"baseline_anisocoria_mm": 2.0, "is_reliable": False}, ["SEIZURE_CONVULSION", "REPEATED_VOMITING"], False, "EMERGENCY_RED",
              ["SYM_REPEATED_VOMITING", "SYM_SEIZURE_CONVULSION", "PLR_LOW_QUALITY", "PLR_SEVERE_ANISOCORIA"]),
}


@pytest.fixture(scope="module")
def tables(spark):
    names = list(CASES)
    reports = spark.createDataFrame([(i, *{**NORMAL, **CASES[n][0]}.values()) for i, n in enumerate(names)], ["session_id", *NORMAL])
    ctx = spark.createDataFrame(
        [(i, CASES[n][1], CASES[n][2]) for i, n in enumerate(names)] + [(99, ["SEIZURE_CONVULSION"], False), (98, [], None)], "session_id long, symptoms array<string>, known_anisocoria boolean"
    )
    return names, ctx, reports


def test_rules(tables):
    names, ctx, reports = tables
    got = {r["session_id"]: r for r in tr.triage(ctx, reports).collect()}
    for i, n in enumerate(names):
        assert got[i]["urgency"] == CASES[n][3], n
        assert [t["id"] for t in got[i]["triggers"]] == CASES[n][4], n
    assert got[names.index("spine")]["directives"][0] == tr.SPINAL and len(got[names.index("spine")]["directives"]) == 5
    assert got[99]["urgency"] == "EMERGENCY_RED" and got[99]["pupillometry"] is None and not got[99]["has_report"]
    assert got[98]["urgency"] == "NORMAL_GREEN"
    assert "4 critical" not in got[0]["summary"] and "(1 critical finding)" in got[names.index("severe")]["summary"]
    assert "(3 critical findings)" in got[names.index("order")]["summary"]


def test_unusable_recordings_can_be_left_out(spark, tables):
    names, ctx, reports = tables
    bad = reports.where("session_id = 0").withColumn("left_response_pattern", F.lit("INCONCLUSIVE")).withColumn("right_response_pattern", F.lit("INCONCLUSIVE"))
    bad = bad.withColumn("left_constriction_pct", F.lit(0.0)).withColumn("right_constriction_pct", F.lit(0.0)).withColumn("is_reliable", F.lit(False))
    only = ctx.where("session_id = 0")
    assert tr.triage(only, bad).first()["urgency"] == "EMERGENCY_RED"
    assert tr.triage(only, bad, TriageSettings(count_unusable_as_fixed=False)).first()["urgency"] == "INCONCLUSIVE_GRAY"
