"""Interval joins, close hashes in crowded buckets, and exact positions, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import alignment, audit, metrics
from reflexgrid.operators.ranks import at_ranks, running_total


def test_intervals_of_all_lengths(spark):
    rng = random.Random(1)
    points = [(s, i, rng.uniform(-50, 2000) if i % 3 else float(rng.randrange(2000))) for s in (1, 2) for i in range(150)] + [(3, 0, 5.0), (1, 999, None)]
    spans = [(s, a, a + rng.choice([0.0, 0.5, 1.0, 3.0, 64.0, 65.0, 500.0, 3000.0])) for s in (1, 2) for a in (float(rng.randrange(-60, 1900)) for _ in range(80))] + [(1, 9.0, 3.0), (4, 0.0, 9.0), (2, None, 1.0)]
    p = spark.createDataFrame(points, "s int, i int, t double")
    got = sorted((r["s"], r["i"], r["a"], r["b"]) for r in alignment.within(p, spark.createDataFrame(spans, "s int, a double, b double"), "s", "t", "a", "b").collect())
    assert got == sorted((s, i, a, b) for s, i, t in points if t is not None for k, a, b in spans if k == s and a is not None and a <= t <= b)
    assert alignment.within(p, spark.createDataFrame([], "s int, a double, b double"), "s", "t", "a", "b").count() == 0


def test_totals_of_intervals_equal_the_join(spark):
    rng = random.Random(7)
    points = [(s, i, rng.uniform(-50, 2000) if i % 3 else float(rng.randrange(2000))) for s in (1, 2) for i in range(400)] + [(1, 998, 7.0), (1, 999, 7.0), (3, 0, None), (None, 5, 7.0)]
    spans = [(s, j, a, a + rng.choice([0.0, 0.5, 3.0, 64.0, 500.0, 3000.0])) for s in (1, 2) for j, a in enumerate(float(rng.randrange(-60, 1900)) for _ in range(80))] + [(1, 90, 9.0, 3.0), (4, 91, 0.0, 9.0), (2, 92, None, 1.0), (1, 93, 7.0, 7.0)]
    p, i = spark.createDataFrame(points, "s int, i int, t double"), spark.createDataFrame(spans, "s int, j int, a double, b double")
    got = sorted(tuple(r) for r in alignment.totals_within(p, i, "s", "t", "a", "b", "i", "j").collect())
    met = alignment.within(p, i.withColumnRenamed("i", "_"), "s", "t", "a", "b").groupBy("j").agg(F.count("*"), F.min("i"), F.max("i"))
    assert got == sorted(tuple(r) for r in met.collect())
    assert alignment.totals_within(p, i.where("false"), "s", "t", "a", "b", "i", "j").count() == 0


def test_totals_of_crowded_intervals_pair_no_points(spark):
    """100,000 frames, 10,000 intervals of half of them each: 500 million pairs are never made."""
    p = spark.range(100_000).select(F.lit(1).alias("s"), F.col("id").alias("i"), F.col("id").cast("double").alias("t"))
    i = spark.range(10_000).select(F.lit(1).alias("s"), F.col("id").alias("j"), F.col("id").cast("double").alias("a"), (F.col("id") + 49_999.0).alias("b"))
    began = time.monotonic()
    rows = alignment.totals_within(p, i, "s", "t", "a", "b", "i", "j").collect()
    assert sorted(tuple(r) for r in rows) == [(j, 50_000, j, j + 49_999) for j in range(10_000)]
    assert time.monotonic() - began < 45


def test_a_thousand_intervals_of_a_session_make_no_product(spark):
    """20,000 frames, 1,000 stimuli of one session: the join itself hands on a few candidates a frame."""
    p = spark.range(20_000).select(F.lit(1).alias("s"), (F.col("id") * 40.0).alias("t"))
    i = spark.range(1000).select(F.lit(1).alias("s"), (F.col("id") * 800.0).alias("a"), (F.col("id") * 800.0 + 200.0).alias("b"))
    out = alignment.within(p, i, "s", "t", "a", "b")
    assert out.count() == 6000
    candidates = [r for r in _probe_counts(p, i)]
    assert sum(candidates) <= 4 * 20_000


def _probe_counts(points, spans):
    """Pairs that share a bucket: those before the time filter."""
    wide = points.withColumn("_b", F.floor(F.col("t") / 256.0)).groupBy("_b").count()
    deal = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("a") / 256.0), F.floor(F.col("b") / 256.0)))).groupBy("_b").agg(F.count("*").alias("m"))
    return [r[0] for r in wide.join(deal, "_b").select(F.col("count") * F.col("m")).collect()]


@pytest.mark.parametrize("heavy", [1_000_000, 20, 0])
def test_close_hashes_in_crowded_buckets(spark, heavy):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(8)]
    crowd = {b ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(8) << rng.choice([0, 20, 50])) for b in base for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)}
    hashes = sorted(crowd)
    left, right = hashes[::2], hashes[1::2] + hashes[:40:2]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    df = lambda v: spark.createDataFrame([(signed(h),) for h in v], "dhash long")
    got = sorted((r["left_hash"], r["right_hash"], r["distance"]) for r in audit.near_hashes(df(left), df(right), heavy=heavy).collect())
    want = sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in left for b in right if (a ^ b).bit_count() <= 2)
    assert got == want and len(want) > 30


def test_many_hashes_that_share_two_blocks(spark):
    """60,000 distinct hashes with the same upper half: one bucket of 3.6 billion pairs without further cuts."""
    one = spark.range(60_000).select((F.col("id") * 71_583 % 4_294_967_291).alias("dhash"))
    start = time.monotonic()
    rows = audit.near_hashes(one, one)
    assert rows.where("left_hash = right_hash").count() == 60_000
    assert time.monotonic() - start < 120


def test_positions_and_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-(2**62), 2**62), i, rng.randrange(5)) for i in range(3000)] + [(7, 5000 + i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(6)
    order = sorted(rows)
    got = {r["k"]: (r["a"], r["b"], r["v"]) for r in at_ranks(df, ["a", "b"], lambda n: [0, 17, n // 2, n - 1, n - 1, n + 5]).collect()}
    assert got == {0: order[0], 1: order[17], 2: order[len(rows) // 2], 3: order[-1], 4: order[-1]}
    total, sums = 0, {}
    for a, b, v in order:
        total += v
        sums[a, b] = total
    assert {(r["a"], r["b"]): r["s"] for r in running_total(df, ["a", "b"], "v", "s").collect()} == sums
    assert at_ranks(df.where("false"), ["a"], lambda n: []).count() == 0


def test_auc_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice([rng.random() * 1e9, 0.5, -3.0])) for _ in range(2000)]
    wins = sum((a > b) + (a == b) / 2 for x, a in rows if x for y, b in rows if not y)
    pos = sum(x for x, _ in rows)
    assert metrics.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()["auc"] == pytest.approx(wins / (pos * (len(rows) - pos)))


def test_unequal_pairs_end_the_job(spark):
    rows = lambda n: spark.createDataFrame([("train", i) for i in range(n)] + [("val", 0)], "split string, name int")
    assert {r["split"]: r["images"] for r in audit.require_pairs(rows(3), rows(3)).collect()} == {"train": 3, "val": 1}
    with pytest.raises(Exception, match="unequal pairs in train: 3 and 4"):
        audit.require_pairs(rows(3), rows(4)).collect()
