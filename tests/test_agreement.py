import contextlib
import io

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import agreement

A = "session_id long, sample_id long, ts_ms double, left_px double, right_px double, center_x double, center_y double"
B = "session_id long, sample_id long, ts_ms double, left_px_b double, right_px_b double, center_x_b double, center_y_b double"


def frames(spark, a, b):
    return agreement.compare_frames(spark.createDataFrame([(1, *r) for r in a], A), spark.createDataFrame([(1, *r) for r in b], B))


def test_differences(spark):
    nan, inf = float("nan"), float("inf")
    a = [(i, float(i), 40.0, 40.0, 100.0, 100.0) for i in range(6)]
    b = [
        (0, 0.0, 40.0, 40.0, 100.0, 100.0), (1, 1.0, 42.0, 40.0, 103.0, 104.0), (2, 2.0, None, 41.0, 100.0, 100.0), (3, 3.0, None, None, 0.0, 0.0),
        (4, 4.0, nan, inf, 100.0, 100.0), (5, 5.5, 40.0, 40.0, 100.0, 100.0),
    ]
    got = {r["sample_id"]: r for r in frames(spark, a, b).collect()}
    assert set(got) == {0, 1, 2, 3, 4}  # the last one is stale
    assert got[0]["mean_diff_px"] == 0 and got[0]["agrees"] and got[0]["comparable"]
    assert got[1]["left_diff_px"] == 2 and got[1]["left_error_pct"] == pytest.approx(5.0) and got[1]["left_distance_px"] == 5 and got[1]["mean_diff_px"] == 1
    assert got[2]["left_diff_px"] is None and got[2]["mean_diff_px"] == 1 and not got[2]["agrees"]
    assert not got[3]["comparable"] and got[3]["mean_diff_px"] is None
    assert not got[4]["left_valid_b"] and got[4]["right_diff_px"] is None


def test_rejects(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0, 0.0, 0.0)], A)
    b = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0, 0.0, 0.0), (1, 1, 1.0, 1.0, 1.0, 0.0, 0.0)], B)
    assert [r["sample_id"] for r in agreement.rejects(a, b).collect()] == [1]


def test_history_and_medians(spark):
    n = 320
    a = [(i, float(i), 40.0, 40.0, 0.0, 0.0) for i in range(n)]
    b = [(i, float(i), 40.0 + (100 if i < 20 else i % 4), None, 3.0, 4.0) for i in range(n)]
    got = agreement.statistics(frames(spark, a, b)).first()
    assert got["n"] == 300 and got["valid_comparisons"] == 300
    assert got["mean_diff_px"] == pytest.approx(1.5) and got["median_diff_px"] == 2  # the upper middle element
    assert got["median_distance_px"] == 5 and got["validity_b_pct"] == 100 and got["agreement_pct"] == 0
    assert got["left_mean_px"] == pytest.approx(41.5) and got["right_mean_px"] == 0
    short = agreement.statistics(frames(spark, a, b), history=2).first()
    assert short["n"] == 2 and short["mean_diff_px"] == pytest.approx(2.5)


def test_signed_deltas(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 40.0, 0.0, 0.0, 0.0)], A)
    b = spark.createDataFrame([(1, 0, 0.0, 38.5, 41.0, 3.0, 4.0)], B)
    r = agreement.signed_deltas(a, b).first()
    assert r["left_delta_px"] == -1.5 and r["right_delta_px"] is None and r["centroid_distance_px"] == 5


def test_statistics_sort_the_frames_once(spark):
    """No join and one exchange: the frames, which may come from a stateful stream, are read once."""
    rows = [(i, float(i), 40.0, 40.0, 0.0, 0.0) for i in range(9)]
    made = frames(spark, rows, rows)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        agreement.statistics(spark.createDataFrame(made.collect(), made.schema), history=2).explain()
    text = out.getvalue()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_sides_with_gaps_keep_their_own_history(spark):
    """The newest two values of a side count, also where they are older than the newest two frames."""
    a = [(i, float(i), 40.0, 40.0, 0.0, 0.0) for i in range(6)]
    b = [(i, float(i), 10.0 * (i + 1) if i < 3 else None, float("inf") if i == 5 else 40.0 + i, 0.0, 0.0) for i in range(6)]
    got = agreement.statistics(frames(spark, a, b), history=2).first()
    assert got["n"] == 2 and got["left_mean_px"] == 25.0 and got["left_std_px"] == 5.0 and got["left_cv_pct"] == 20.0
    assert got["right_mean_px"] == 43.5
