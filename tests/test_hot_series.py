"""A hot key is cut into chunks; the results must be those of one window over the key."""

import pytest
from compare import difference
from pyspark.sql import functions as F

from reflexgrid.config import HeatSettings
from reflexgrid.operators import agreement, features, kinetics, live, signal
from reflexgrid.operators.ordered import Layout
from reflexgrid.plans import fixtures as fx

TINY = HeatSettings(max_rows=10, chunk_ms=300.0)
KEYS, ORDER = ("session_id",), ("frame_ts_ms", "sample_id")


@pytest.fixture(scope="module")
def both(spark, sf):
    return fx.recording(spark, sf), fx.recording(spark, sf, TINY)


def same(rows_of, a, b):
    assert difference(rows_of(a), rows_of(b)) is None


def test_all_sessions_are_hot(both):
    calm, hot = both
    assert calm.heat.hot is None and hot.heat.hot is not None
    assert hot.heat.hot.count() == calm.samples.select("session_id").distinct().count()


def test_only_some_keys_hot(spark, sf, both, rows_of):
    some = fx.recording(spark, sf, HeatSettings(max_rows=66, chunk_ms=300.0))
    total = both[0].samples.select("session_id").distinct().count()
    assert 0 < some.heat.hot.count() < total
    same(rows_of, both[0].clean(), some.clean())


def test_samples(both, rows_of):
    same(rows_of, both[0].samples, both[1].samples)


@pytest.mark.parametrize("fn", [signal.repair_gaps, signal.clean_series, lambda d, y: signal.smooth(signal.repair_gaps(d, y), y, size=7), lambda d, y: kinetics.eye_features(signal.clean_series(d, y), y)])
def test_eye_series(both, rows_of, fn):
    cut = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    same(rows_of, cut(both[0].per_eye(fn)), cut(both[1].per_eye(fn)))


LIVE = {
    "stability": live.stability,
    "lost_runs": live.lost_runs,
    "rolling": lambda d, y: live.rolling_stats(d, y, "left_px"),
    "mean": lambda d, y: live.rolling_mean(d, y, "left_px", 20, "m"),
    "repeats": lambda d, y: live.drop_repeats(d, y, "media"),
    "increasing": lambda d, y: live.increasing(d, y, "ts_late", "up"),
    "throttle": lambda d, y: live.throttle(d, y, "frame_ts_ms", 100.0),
    "stabilise": lambda d, y: live.stabilise(d, y),
}


@pytest.mark.parametrize("name", LIVE)
def test_live(both, rows_of, name):
    def prepare(rec):
        e = F.col("sample_id")
        return rec.samples.select(
            "session_id", "sample_id", "frame_ts_ms", "left_px", "right_px", F.col("left_px").isNotNull().alias("valid"), F.col("left_px").alias("px"),
            F.col("left_mm").alias("mm"), (F.lit(0.3) + (e % 7) * F.lit(0.05)).alias("x"), (F.lit(0.4) + (e % 3) * F.lit(0.01)).alias("y"),
            F.floor(F.col("frame_ts_ms") / 200).alias("media"), (F.col("frame_ts_ms").cast("long") - (e % 4) * 120).alias("ts_late"),
        )

    cut = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    run = lambda rec: cut(rec.heat.apply(prepare(rec), KEYS, ORDER, LIVE[name]))
    same(rows_of, run(both[0]), run(both[1]))


def test_asof_and_jitter(both, rows_of):
    def asof(rec):
        a = rec.samples.select("session_id", "sample_id", F.col("frame_ts_ms").alias("ts_ms"))
        return agreement.latest_before(a, fx.method_b(rec.samples).where("sample_id % 3 <> 0"), rec.heat, ["left_px_b"])

    same(rows_of, asof(both[0]), asof(both[1]))

    def jitter(rec):
        pts = rec.samples.select("session_id", "frame_ts_ms", "sample_id", (F.col("sample_id") % 4).alias("x"), (F.col("sample_id") % 3).alias("y"))
        return features.centre_jitter(pts, rec.heat).select("session_id", F.round("landmark_jitter", 9).alias("j"))

    same(rows_of, jitter(both[0]), jitter(both[1]))


def test_zero_time_step_repeats_last_slope_across_chunks(spark, rows_of):
    times = [0.0, 50.0, 50.0, 50.0, 50.0, 100.0, 150.0]
    rows = [("s", "L", t, i, float(i)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "session_id string, eye string, time_ms double, sample_id long, clean_mm double")
    keys, order = ("session_id", "eye"), ("time_ms", "sample_id")
    plain = signal.differentiate(df, Layout(keys, order))
    cut = signal.differentiate(df.withColumn("_c", F.floor(F.col("sample_id") / 2)), Layout(keys, order, "_c")).drop("_c")
    got = [r["velocity"] for r in sorted(plain.collect(), key=lambda r: r["sample_id"])]
    assert got == pytest.approx([20.0, 40.0, 40.0, 40.0, 40.0, 20.0, 20.0])
    same(rows_of, plain, cut)


@pytest.mark.parametrize("warm_up", [0, 3, 64])
def test_folds_over_dense_chunks(spark, rows_of, warm_up):
    """No gap and no loss anywhere, so nothing restarts the folds; wrong guesses must be repaired."""
    import random

    rnd = random.Random(1)
    rows = [(s, i, i * 33.0 + rnd.random(), 40 + 5 * rnd.random(), rnd.random(), rnd.random(), 2 + rnd.random()) for s in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id long, sample_id long, frame_ts_ms double, px double, x double, y double, mm double")
    plain, cut = Layout(KEYS, ORDER), Layout(KEYS, ORDER, "_c")
    chunked = df.withColumn("_c", F.floor(F.col("sample_id") / 25))
    same(rows_of, live.throttle(df, plain, "frame_ts_ms", 100.0), live.throttle(chunked, cut, "frame_ts_ms", 100.0).drop("_c"))
    same(rows_of, live.stabilise(df, plain), live.stabilise(chunked, cut, warm_up=warm_up).drop("_c"))
