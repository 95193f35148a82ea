import math

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import bitmaps, components, masks


def shapes(spark):
    disc = [(y, x) for y in range(100) for x in range(120) if (x - 60) ** 2 + (y - 50) ** 2 <= 400]
    rect = [(y, x) for y in range(80, 120) for x in range(100, 150)]
    two = [(y, x) for y in range(5) for x in range(8)] + [(y, x) for y in range(20, 23) for x in range(4)]
    ell = [(y, 0) for y in range(10)] + [(9, x) for x in range(1, 10)]
    noise = [(1, 1), (5, 5), (9, 9)]
    snake = [(y, x) for y in range(0, 40, 2) for x in range(30)] + [(y, 29 if y % 4 == 1 else 0) for y in range(1, 40, 2)]
    diagonal = [(i, i) for i in range(12)] + [(i, 11 - i + 14) for i in range(12)]
    rows = [("t", n, y, x) for n, pts in enumerate([disc, rect, two, ell, noise, snake, diagonal]) for y, x in pts]
    return spark.createDataFrame(rows, "split string, sample long, y int, x int")


def test_geometry(spark):
    got = {r["sample"]: r for r in masks.region_geometry(masks.component_runs(shapes(spark)), 640, 480).collect()}
    assert got[0]["cx"] == pytest.approx(60) and got[0]["cy"] == pytest.approx(50) and got[0]["diameter"] == pytest.approx(40, abs=0.6) and got[0]["circularity"] > 0.9
    assert (got[1]["area"], got[1]["bx0"], got[1]["by0"], got[1]["bw"], got[1]["bh"], got[1]["perimeter"]) == (2000, 100, 80, 50, 40, 176)
    assert got[1]["cx"] == pytest.approx(124.5) and got[1]["cy"] == pytest.approx(99.5)
    assert got[2]["area"] == 40
    assert got[3]["area"] == 19 and got[3]["bw"] == 10 and got[3]["circularity"] == pytest.approx(4 * math.pi * 19 / 19**2)
    assert 4 not in got
    assert got[5]["area"] == 620
    assert got[6]["area"] == 12 and got[6]["cx"] == pytest.approx(5.5)  # equal sizes: the first one wins


def test_strips_give_the_same_labels(spark):
    runs = components.to_runs(shapes(spark))
    key = lambda df: sorted((r["sample"], r["run"], r["label"]) for r in df.collect())
    assert key(components.label_runs(runs)) == key(components.label_runs(runs, tile=3)) == key(components.label_runs(runs, tile=16))


def flood(image):
    """{(y, x): first pixel of its component} and {(y, x): on the rim}, pixel by pixel."""
    left = {(y, x) for y, line in enumerate(image) for x, v in enumerate(line) if v}
    every, label = set(left), {}
    while left:
        seed = min(left)
        group, todo = {seed}, [seed]
        left.discard(seed)
        while todo:
            y, x = todo.pop()
            for p in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    group.add(p)
                    todo.append(p)
        label |= dict.fromkeys(group, seed)
    return label, {p: not all((p[0] + a, p[1] + b) in every for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for p in every}


@pytest.mark.parametrize("tile", [1024, 7, 1])
def test_bitmaps_equal_a_flood_fill(spark, tile):
    import numpy as np

    rng = np.random.default_rng(3)
    images = [(rng.random((h, w)) < p).astype(np.uint8) for h, w, p in ((30, 41, 0.4), (30, 41, 0.62), (1, 9, 0.5), (9, 1, 0.5), (64, 41, 0.5), (5, 5, 0), (5, 5, 1))]
    rows = [("t", n, i.shape[0], i.shape[1], i.tobytes()) for n, i in enumerate(images)] + [("t", 90, 0, 0, b""), ("t", 91, -1, -1, None)]
    df = spark.createDataFrame(rows, "split string, sample long, height int, width int, data binary")
    got = {n: ({}, {}) for n in range(len(images))}
    for r in bitmaps.label_images(df, tile=tile).collect():
        label, rim = got[r["sample"]]
        label |= {(r["y"], x): (r["label"] // components.LINE, r["label"] % components.LINE) for x in range(r["x0"], r["x1"] + 1)}
        rim[r["y"], r["x0"], r["x1"]] = r["rim"]
    for n, image in enumerate(images):
        label, rim = flood(image)
        assert got[n][0] == label
        assert all(k == sum(rim[y, x] for x in range(a, b + 1)) for (y, a, b), k in got[n][1].items())


def test_camera_frame_and_striped_image(spark):
    """A 640x480 frame of blobs, and a tall image whose stripes are tied at alternating ends: one component over all its strips."""
    import numpy as np

    rng = np.random.default_rng(4)
    frame = np.zeros((480, 640), np.uint8)
    yy, xx = np.mgrid[:480, :640]
    for _ in range(60):
        cy, cx, r = rng.integers(0, 480), rng.integers(0, 640), rng.integers(3, 40)
        frame[(yy - cy) ** 2 + (xx - cx) ** 2 <= r * r] = 1
    stripes = np.zeros((3000, 200), np.uint8)
    stripes[::2] = 1
    stripes[1::4, 0] = stripes[3::4, 199] = 1
    df = spark.createDataFrame([("t", 0, 480, 640, frame.tobytes()), ("t", 1, 3000, 200, stripes.tobytes())], "split string, sample long, height int, width int, data binary")
    out = {r["sample"]: r for r in bitmaps.geometry(bitmaps.label_images(df, tile=100)).collect()}
    label, rim = flood(frame)
    sizes = {}
    for seed in label.values():
        sizes[seed] = sizes.get(seed, 0) + 1
    best = min(sizes, key=lambda s: (-sizes[s], s))
    pixels = [p for p, seed in label.items() if seed == best]
    assert out[0]["area"] == len(pixels) and out[0]["perimeter"] == sum(rim[p] for p in pixels)
    assert out[0]["cx"] == pytest.approx(sum(x for _, x in pixels) / len(pixels)) and out[0]["bh"] == max(y for y, _ in pixels) - min(y for y, _ in pixels) + 1
    assert (out[1]["area"], out[1]["bw"], out[1]["bh"]) == (int(stripes.sum()), 200, 3000)


def test_brute_force_components(spark):
    import random

    rnd = random.Random(5)
    rows = [("t", s, y, x) for s in range(4) for y in range(30) for x in range(30) if rnd.random() < 0.35]
    got = {(r["sample"], r["y"], x): r["label"] for r in masks.component_runs(spark.createDataFrame(rows, "split string, sample long, y int, x int")).collect() for x in range(r["x0"], r["x1"] + 1)}
    left = {(s, y, x) for _, s, y, x in rows}
    while left:
        seed = min(left)
        group, todo = {seed}, [seed]
        while todo:
            s, y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p = (s, y + dy, x + dx)
                    if p in left and p not in group:
                        group.add(p)
                        todo.append(p)
        left -= group
        assert {got[p] for p in group} == {seed[1] * components.LINE + seed[2]}


def test_status(spark):
    df = spark.createDataFrame([(0.9, 40.0, 100.0, 60), (0.2, 40.0, 100.0, 60), (0.9, 90.0, 100.0, 49), (1.3, 3.9, 100.0, 10)], "c double, d double, w double, a int")
    s, k = masks.geometry_status(F.col("c"), F.col("d"), F.col("w"))
    got = df.select(s, k, masks.area_confidence(F.col("c"), F.col("a"))).collect()
    assert [r[0] for r in got] == ["DETECTED", "UNCERTAIN", "UNCERTAIN", "UNCERTAIN"]
    assert [r[1] for r in got] == pytest.approx([0.9, 0.1, 0.45, 0.5]) and [r[2] for r in got] == pytest.approx([0.9, 0.2, 0.45, 0.5])


def test_absent_class_gives_zero_row(spark):
    m = spark.createDataFrame([("t", 1, 0, 0, 1), ("t", 1, 0, 1, 3)], "split string, sample long, y int, x int, class int")
    r = masks.class_geometry(m, 2).first()
    assert (r["area"], r["width"], r["height"], r["cx"], r["aspect"]) == (0, 0, 0, 0.0, 0.0)


def test_contact_counts_corners_twice(spark):
    m = spark.createDataFrame([("t", 1, y, x, 2) for y in range(4) for x in range(4)], "split string, sample long, y int, x int, class int")
    r = masks.boundary_contact(m, 2, 4, 4).first()
    assert r["contact"] == 16 and r["box_touches"] and r["touches"]


def test_leak_class(spark):
    df = spark.createDataFrame([(True, 2.9, 0.96), (True, 3.0, 0.99), (False, 0.0, 1.0)], "s boolean, m double, d double")
    kind, advice = masks.leak_class(F.col("s"), F.col("m"), F.col("d"))
    got = [tuple(r) for r in df.select(kind, advice).collect()]
    assert got == [("LIKELY_DUPLICATE", "REMOVE_FROM_VALIDATION"), ("LIKELY_SAME_SEQUENCE / NEAR_DUPLICATE", "REMOVE_FROM_VALIDATION"), ("LIKELY_DIFFERENT_SAMPLE", "KEEP")]


def test_landmarks_and_crops(spark):
    from reflexgrid.functions import landmarks as lmk

    pts = [{"x": 0.5, "y": 0.5, "z": 0.0}] * 478
    pts = [dict(p) for p in pts]
    for i, dx, dy in ((469, 0, -0.02), (470, 0.02, 0), (471, 0, 0.02), (472, -0.02, 0)):
        pts[i] = {"x": 0.5 + dx, "y": 0.5 + dy, "z": 0.0}
    for i, x in zip(lmk.LEFT_EYE, range(16)):
        pts[i] = {"x": 0.4 + x * 0.01, "y": 0.5, "z": 0.0}
    df = spark.createDataFrame([(1, pts), (2, pts[:468]), (3, pts[:100]), (4, None)], "k long, lm array<struct<x: double, y: double, z: double>>")
    lm = F.col("lm")
    status, text = lmk.tracking(lm, lmk.left_eye(lm), lmk.right_eye(lm), lmk.left_iris(lm), lmk.right_iris(lm))
    got = {r["k"]: r for r in df.select("k", lmk.left_eye(lm).alias("e"), lmk.left_iris(lm).alias("i"), status.alias("s"), text.alias("t")).collect()}
    assert got[1]["e"]["width"] == pytest.approx(0.15) and got[1]["i"]["radius"] == pytest.approx(0.02)
    assert got[2]["i"] is None and got[2]["e"] is not None and got[3]["e"] is None and got[4]["e"] is None
    assert got[4]["s"] == "LOST" and got[2]["t"] == lmk.GUIDANCE["iris"] and got[3]["t"] == lmk.GUIDANCE["eyes"]
    one = spark.range(1)
    crop = one.select(lmk.eye_crop(F.lit(0.5), F.lit(0.5), F.lit(0.1), 1280.0, 720.0).alias("c"), lmk.eye_crop(F.lit(0.01), F.lit(0.5), F.lit(0.1), 1280.0, 720.0).alias("n")).first()
    assert tuple(crop["c"]) == (480.0, 240.0, 320.0, 240.0) and crop["n"] is None
    back = one.select(lmk.roi_to_frame(F.lit(128.0), F.lit(96.0), F.lit(40.0), F.lit(100.0), F.struct(F.lit(480.0).alias("x"), F.lit(240.0).alias("y"), F.lit(320.0).alias("w"), F.lit(240.0).alias("h")), 256.0, 192.0)).first()[0]
    assert (back["x"], back["y"], back["diameter"]) == (640.0, 360.0, 50.0)
    c = one.select(lmk.centre_crop(F.lit(640), F.lit(480)).alias("a"), lmk.centre_crop(F.lit(100), F.lit(100)).alias("b"), lmk.centre_crop(F.lit(200), F.lit(90)).alias("c")).first()
    assert tuple(c["a"]) == (0, 0, 640, 480) and tuple(c["b"]) == (0, 12, 100, 75) and tuple(c["c"]) == (40, 0, 120, 90)

