"""Synthetic recordings with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import kinetics, signal
from reflexgrid.operators.ordered import Heat, Layout
from reflexgrid.plans.recording import Recording

LAY = Layout(("session_id", "eye"), ("time_ms", "sample_id"))


def series(spark, points):
    rows = [(1, "L", float(t), i, None if v is None else float(v), float(c)) for i, (t, v, c) in enumerate(points)]
    return spark.createDataFrame(rows, "session_id long, eye string, time_ms double, sample_id long, raw_mm double, confidence double")


def column(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["sample_id"])]


def test_short_gap_is_interpolated(spark):
    got = signal.repair_gaps(series(spark, [(0, 4.0, 95), (50, 4.0, 95), (100, None, 20), (150, None, 20), (200, 3.4, 95), (250, 3.2, 95)]), LAY)
    assert column(got, "raw_mm") == pytest.approx([4.0, 4.0, 3.8, 3.6, 3.4, 3.2])
    assert column(got, "is_interpolated") == [False, False, True, True, False, False]
    assert column(got, "confidence")[2] == pytest.approx(66.5)


def test_long_gap_is_dropped_and_ends_are_held(spark):
    got = signal.repair_gaps(series(spark, [(0, None, 95), (90, None, 95), (100, 4.0, 80), (300, None, 95), (500, 3.0, 80), (590, None, 20), (700, None, 20)]), LAY)
    assert column(got, "time_ms") == [0.0, 90.0, 100.0, 500.0, 590.0]
    assert column(got, "raw_mm") == [4.0, 4.0, 4.0, 3.0, 3.0]
    assert column(got, "confidence") == [40.0, 40.0, 80.0, 80.0, 40.0]


@pytest.mark.parametrize("value", [0.99, 9.51, float("nan"), float("inf")])
def test_impossible_values_are_gaps(spark, value):
    got = signal.repair_gaps(series(spark, [(0, 4.0, 95), (50, value, 95), (100, 4.2, 95)]), LAY)
    assert column(got, "raw_mm") == pytest.approx([4.0, 4.1, 4.2])


def test_low_confidence_is_a_gap(spark):
    assert column(signal.repair_gaps(series(spark, [(0, 4.0, 95), (50, 8.0, 19.9), (100, 4.0, 95)]), LAY), "raw_mm") == pytest.approx([4.0] * 3)


def test_smoothing_reduces_noise_and_keeps_polynomials(spark):
    noisy = [4.0, 4.1, 3.9, 4.05, 3.95, 4.1, 3.9, 4.0, 4.05]
    got = column(signal.smooth(series(spark, [(i * 33, v, 95) for i, v in enumerate(noisy)]), LAY), "clean_mm")
    spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v)
    assert spread(got) < spread(noisy)
    for size in (5, 7):
        curve = [2 + 0.1 * i + 0.02 * i * i for i in range(12)]
        got = column(signal.smooth(series(spark, [(i, v, 95) for i, v in enumerate(curve)]), LAY, size=size), "clean_mm")
        assert got[3:9] == pytest.approx(curve[3:9])


def test_short_series(spark):
    two = column(signal.smooth(series(spark, [(0, 3.0, 95), (1, 5.0, 95)]), LAY), "clean_mm")
    assert two == [3.0, 5.0]
    three = column(signal.smooth(series(spark, [(0, 3.0, 95), (1, 6.0, 95), (2, 3.0, 95)]), LAY), "clean_mm")
    assert three == pytest.approx([4.0, 4.5, 4.0])


def test_ramp_velocity(spark):
    df = series(spark, [(i * 50, 5 - 0.1 * i, 95) for i in range(10)]).withColumnRenamed("raw_mm", "clean_mm")
    moving = signal.differentiate(df, LAY)
    assert column(moving, "velocity") == pytest.approx([-2.0] * 10)
    assert column(signal.differentiate(moving, LAY, value="velocity", out="acc"), "acc") == pytest.approx([0.0] * 10, abs=1e-9)
    one = signal.differentiate(series(spark, [(0, 4.0, 95)]).withColumnRenamed("raw_mm", "clean_mm"), LAY)
    assert column(one, "velocity") == [0.0]


def recorded(spark, curves):
    """curves: {session: (left, right)} functions of stimulus-relative ms; 30 FPS, 5.2 s, onset 1500."""
    rows = []
    for sid, (left, right) in curves.items():
        for i in range(int(5200 / 33.333) + 1):
            ts = i * 33.333
            lv, rv = left(ts - 1500), right(ts - 1500)
            rows.append((sid, i, ts, ts - 1500, lv, rv, 95.0, None if lv is None else lv * 20, None if rv is None else rv * 20))
    schema = "session_id long, sample_id long, frame_ts_ms double, time_ms double, left_mm double, right_mm double, confidence double, left_px double, right_px double"
    samples = spark.createDataFrame(rows, schema)
    return Recording(samples, Heat("session_id"))


def reflex(base, nadir):
    def at(t):
        if t <= 220:
            return base
        if t <= 1100:
            return base - (base - nadir) * 0.5 * (1 - math.cos(math.pi * (t - 220) / 880))
        return nadir + (base - nadir) * 0.6 * min(1.0, (t - 1100) / 2500)

    return at


def test_recordings(spark):
    blink = lambda t: None if -300 < t < -150 else reflex(4.2, 2.8)(t)
    rec = recorded(spark, {1: (reflex(4.2, 2.8), reflex(4.15, 2.8)), 2: (reflex(4.5, 3.0), reflex(3.2, 3.0)), 3: (lambda t: 5.0, lambda t: 5.0), 4: (blink, blink), 5: (lambda t: None, lambda t: None)})
    got = {r["session_id"]: r for r in rec.report().collect()}
    one = got[1]
    assert one["left_baseline_mm"] == pytest.approx(4.2, abs=0.05) and one["left_min_mm"] == pytest.approx(2.8, abs=0.1)
    assert one["left_constriction_pct"] == pytest.approx(33.3, abs=2.5) and 180 <= one["left_latency_ms"] <= 380
    assert 1.8 <= one["left_mcv_mm_s"] <= 3.2 and one["left_time_to_min_ms"] == pytest.approx(1100, abs=70)
    assert one["left_response_pattern"] == "NORMAL_REACTIVE" and one["is_reliable"] and one["asymmetry_severity"] == "SYMMETRIC" and one["notes"] == []
    assert got[2]["asymmetry_severity"] == "MARKED_ASYMMETRY" and got[2]["baseline_anisocoria_mm"] == pytest.approx(1.3, abs=0.05)
    assert got[3]["left_response_pattern"] == "NON_REACTIVE_FIXED" and got[3]["right_response_pattern"] == "NON_REACTIVE_FIXED"
    assert got[4]["left_response_pattern"] == "NORMAL_REACTIVE" and got[4]["left_min_mm"] == pytest.approx(2.8, abs=0.1)
    assert got[5]["left_response_pattern"] == "INCONCLUSIVE" and got[5]["left_constriction_pct"] == 0 and not got[5]["is_reliable"]


def test_baseline_px_is_the_last_one_before_the_stimulus(spark):
    rows = [(1, 0, 0.0, -20.0, 80.0, 70.0), (1, 1, 10.0, -10.0, 81.0, None), (1, 2, 15.0, -5.0, 0.0, 72.0), (1, 3, 20.0, 0.0, 99.0, 99.0)]
    df = spark.createDataFrame(rows, "session_id long, sample_id long, frame_ts_ms double, time_ms double, left_px double, right_px double")
    assert {r["eye"]: r["base_px"] for r in kinetics.baseline_px(df).collect()} == {"L": 81.0, "R": 72.0}


def test_frame_functions(spark):
    from reflexgrid.functions import samples as fs

    rows = [(None, 40.0, 100.0, True), (None, 40.0, 4.0, True), (3.14159, 40.0, 100.0, True), (None, 40.0, 100.0, False), (None, None, 100.0, True)]
    df = spark.createDataFrame(rows, "mm double, px double, iris double, found boolean")
    got = [r[0] for r in df.select(fs.px_to_mm(F.col("mm"), F.col("px"), F.col("iris"), F.col("found"))).collect()]
    assert got == [2.34, 4.0, 3.142, None, None]
