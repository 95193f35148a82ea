"""Chains of kept rows: plain loops, step functions, and one very hot session."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import live
from reflexgrid.operators.ordered import Layout
from reflexgrid.operators.pointers import Steps, followers, last_of, reached


def loop(t, interval):
    last, keep = None, []
    for i, v in enumerate(t):
        if last is None or v - last >= interval:
            last = v
            keep.append(i)
    return keep


def series(rng, n):
    return np.cumsum([rng.choice([0.0, 0.1, 1.0, 3.0, 40.0]) * rng.random() for _ in range(n)])


def test_doubling_equals_a_loop():
    rng = random.Random(1)
    for _ in range(200):
        t, interval = series(rng, rng.randrange(1, 80)), rng.choice([0.1, 1.0, 5.0, 100.0])
        after = followers(t, interval)
        assert sorted(reached(after, 0)) == loop(t, interval)
        assert [last_of(after)[0]] == loop(t, interval)[-1:]
    # 0.3 - 0.1 is less than 0.2
    t = np.array([0.1, 0.3, 0.31])
    assert sorted(reached(followers(t, 0.2), 0)) == loop(t, 0.2)


def test_composed_steps_equal_a_loop():
    rng = random.Random(2)
    for _ in range(300):
        t, interval = np.unique(series(rng, rng.randrange(2, 90))), rng.choice([0.3, 2.0, 9.0])
        borders = sorted(rng.sample(range(1, len(t)), min(len(t) - 1, rng.randrange(1, 8)))) if len(t) > 1 else []
        run = [Steps.of(p, interval) for p in np.split(t, borders)]
        cut = rng.randrange(1, len(run)) if len(run) > 1 else 0
        kept = float("-inf")
        for f in [Steps.joined(run[:cut], interval), Steps.joined(run[cut:], interval)] if cut else run:
            kept = f(kept, interval)
        assert kept == t[loop(t, interval)[-1]]


@pytest.mark.parametrize("fan", [2, 256])
def test_chunks_equal_the_whole(spark, fan):
    rng = random.Random(3)
    rows = [(k, i, float(v)) for k in (1, 2) for i, v in enumerate(series(rng, 600) * 50)] + [(3, 0, None), (3, 1, 5.0)]
    df = spark.createDataFrame(rows, "k int, i int, t double").withColumn("c", F.floor(F.col("t") / 300))
    from reflexgrid.operators.pointers import spaced

    got = {(r["k"], r["i"]) for r in spaced(df, Layout(("k",), ("t", "i"), "c"), "t", 100.0, fan).collect()}
    plain = {(r["k"], r["i"]) for r in spaced(df, Layout(("k",), ("t", "i")), "t", 100.0).collect()}
    want = {(3, 1)}
    for k in (1, 2):
        mine = sorted((t, i) for a, i, t in rows if a == k)
        want |= {(k, mine[j][1]) for j in loop([t for t, _ in mine], 100.0)}
    assert got == plain == want


def test_a_million_frames_of_one_session(spark):
    """40 ms frames, 100 ms interval: the chain is that of the loop, in at most 25 jobs."""
    df = spark.range(1_000_000).select(F.lit(7).alias("s"), F.col("id").alias("i"), (F.col("id") * 40.0 + F.col("id") % 7).alias("t")).withColumn("c", F.floor(F.col("t") / 60_000))
    spark.sparkContext.setJobGroup("hot", "hot")
    try:
        out = live.throttle(df, Layout(("s",), ("t", "i"), "c"), "t", 100.0)
        got = np.sort(np.array([r["i"] for r in out.select("i").collect()]))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("hot")) <= 25
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    i = np.arange(1_000_000)
    assert (got == np.array(loop((i * 40.0 + i % 7).tolist(), 100.0))).all()


def test_crowded_chunks_compose_without_a_product():
    """Half a million distinct times, 80,000 of them before the first interval has passed: composing takes a moment, not entries times entries."""
    t = np.unique(np.random.default_rng(4).integers(0, 6_000_000, 500_000).astype(float))
    began = time.monotonic()
    run = [Steps.of(p, 500_000.0) for p in np.split(t, np.searchsorted(t, [1e6, 2e6, 3e6, 4e6, 5e6]))]
    whole = Steps.joined(run, 500_000.0)
    assert time.monotonic() - began < 10
    assert whole(float("-inf"), 500_000.0) == t[loop(t.tolist(), 500_000.0)[-1]]
    assert len(whole.at) < 10_000
