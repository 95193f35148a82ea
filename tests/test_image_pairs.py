"""Pair metrics on whole images against plain numbers; one image with very many partners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import masks
from reflexgrid.operators.image_pairs import dealt, pair_metrics

SCHEMA = "split string, sample long, lum binary, cls binary"


def images(rng, n, size=48):
    lum = rng.integers(0, 256, (n, size)).astype(float)
    return lum, rng.integers(0, 4, (n, size)).astype(np.uint8)


def test_metrics_equal_those_of_pixel_rows(spark):
    rng = np.random.default_rng(5)
    lum, cls = images(rng, 12)
    lum[3] = 7.0  # flat: no correlation
    rows = [("val" if i < 6 else "train", i, lum[i].tobytes(), cls[i].tobytes()) for i in range(12)] + [("val", 20, lum[0][:5].tobytes(), cls[0][:5].tobytes()), ("train", 0, lum[1].tobytes(), cls[1].tobytes())]
    pairs = [(a, b) for a in range(6) for b in range(6, 12) if (a + b) % 3] + [(20, 6), (99, 7), (0, 0), (0, 0)]
    pair_rows = spark.createDataFrame(pairs, "pair_a long, pair_b long")
    got = {(r["pair_a"], r["pair_b"]): r for r in pair_metrics(pair_rows, spark.createDataFrame(rows, SCHEMA), block=2).collect()}
    pixels = [(s, n, 0, x, float(v), int(c)) for s, n, a, k in rows if n != 20 for x, (v, c) in enumerate(zip(np.frombuffer(a), k))]
    table = spark.createDataFrame(pixels, "split string, sample long, y int, x int, lum double, class int")
    want = {(r["pair_a"], r["pair_b"]): r for r in masks.pair_metrics(masks.pair_pixels(pair_rows.distinct(), table, ["lum", "class"])).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("mae", "rmse", "max_diff", "iou", "dice", "pearson"):
            assert got[k][c] == (None if w[c] is None else pytest.approx(w[c])), (k, c)


def test_ten_thousand_partners_of_one_image(spark):
    """The hot image goes to many blocks of bounded size, its partners to one each, on whichever side it is."""
    rng = np.random.default_rng(6)
    lum, cls = images(rng, 3)
    many = spark.range(10_000)
    flip = many.select(F.lit("train").alias("split"), (F.col("id") + 10).alias("sample"), F.lit(lum[1].tobytes()).alias("lum"), F.lit(cls[1].tobytes()).alias("cls"))
    one = spark.createDataFrame([("val", 1, lum[0].tobytes(), cls[0].tobytes())], SCHEMA)
    pairs = many.select(F.lit(1).cast("long").alias("pair_a"), (F.col("id") + 10).alias("pair_b"))
    sizes = dealt(pairs, 32).groupBy("anchor", "blk").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 80 and sizes[1] >= 300
    out = pair_metrics(pairs, one.unionByName(flip))
    row = out.agg(F.count("*").alias("n"), F.min("mae").alias("low"), F.max("mae").alias("high")).first()
    assert row["n"] == 10_000 and row["low"] == row["high"] == pytest.approx(np.abs(lum[0] - lum[1]).mean())
    turned = dealt(pairs.select(F.col("pair_b").alias("pair_a"), F.col("pair_a").alias("pair_b")), 32)
    assert turned.where("on_a or anchor <> 1").count() == 0
