"""Image files, stores and exports."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import audit, pixels
from reflexgrid.schemas import FINAL_RECORD
from reflexgrid.session import scratch
from reflexgrid.sources import exports, images, stores
from reflexgrid.streaming import jobs


def png(path, rows, colour=False):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in (p if colour else (p,))) for row in rows)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if colour else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("collection"))
    gray = [[10 * y + x for x in range(4)] for y in range(3)]
    png(f"{root}/train/image/001_a.png", gray)
    png(f"{root}/train/segmentation/001_a.png", [[(x + y) % 4 for x in range(4)] for y in range(3)])
    png(f"{root}/val/image/002_b.png", [[(200, 100, 50)] * 2] * 2, colour=True)
    for name in ("train/image/broken.png", "train/image/desktop.ini", "val/image/.hidden.png"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(b"no image")
    return root


def test_scan(spark, folder):
    found = images.scan_images(spark, folder)
    names = {(r["split"], r["kind"], r["name"]) for r in images.readable(found).collect()}
    assert names == {("train", "image", "001_a.png"), ("train", "segmentation", "001_a.png"), ("val", "image", "002_b.png")}
    assert [r["name"] for r in images.corrupt(found).collect()] == ["broken.png"]
    assert {r["name"] for r in images.artifacts(spark, folder).collect()} == {"desktop.ini"}


def test_formats(spark, folder):
    got = {(r["split"], r["kind"], r["width"], r["height"], r["nChannels"]): r["files"] for r in audit.distinct_formats(images.readable(images.scan_images(spark, folder))).collect()}
    assert got == {("train", "image", 4, 3, 1): 1, ("train", "segmentation", 4, 3, 1): 1, ("val", "image", 2, 2, 3): 1}


def test_pixels(spark, folder):
    found = images.readable(images.scan_images(spark, folder)).where("kind = 'image'")
    got = {(r["name"], r["y"], r["x"]): r["lum"] for r in images.gray_pixels(found, ["split", "name"]).collect()}
    assert len(got) == 12 + 4 and got["001_a.png", 2, 3] == 23
    assert got["002_b.png", 0, 0] == pytest.approx(0.299 * 200 + 0.587 * 100 + 0.114 * 50)
    classes = images.to_pixels(images.readable(images.scan_images(spark, folder)).where("kind = 'segmentation'"), ["name"])
    assert sorted(r["value"] for r in classes.collect()) == sorted((x + y) % 4 for x in range(4) for y in range(3))


def test_store_round(spark):
    path = scratch(spark, "store")
    row = lambda i, s, t: (i, s, t, 80.0, 81.0, t, 1500.0, 80.0, 81.0, 200.0, "FINALIZED")
    new = spark.createDataFrame([row(1, 10, "a"), row(2, 10, "b"), row(3, 11, "a")], FINAL_RECORD)
    ids = lambda: sorted(r["id"] for r in stores.read_finals(spark, path).collect())
    stores.insert_finals(new, path)
    assert ids() == [1, 3]
    stores.insert_finals(new.unionByName(spark.createDataFrame([row(4, 12, "c")], FINAL_RECORD)), path)
    assert ids() == [1, 3, 4]
    stores.delete_ids(stores.read_finals(spark, path).where("session_id = 11"), path)
    assert ids() == [1, 4]
    stores.insert_finals(spark.createDataFrame([row(5, 11, "d")], FINAL_RECORD), path)
    assert ids() == [1, 4, 5]
    stores.compact(spark, path, FINAL_RECORD)
    assert ids() == [1, 4, 5]
    for _ in range(2):  # the same record again after its deletion, also under its old id
        stores.delete_ids(stores.read_finals(spark, path).where("id = 5"), path)
        assert ids() == [1, 4]
        stores.insert_finals(spark.createDataFrame([row(5, 11, "d")], FINAL_RECORD), path)
        stores.insert_finals(spark.createDataFrame([row(5, 11, "d")], FINAL_RECORD), path)
        assert ids() == [1, 4, 5]
    other = scratch(spark, "store")
    stores.append(new, other)
    stores.clear(spark, path, FINAL_RECORD)
    assert ids() == [] and stores.read_finals(spark, other).count() == 3


def test_subscribers_see_new_rows(spark):
    path = scratch(spark, "store")
    row = (1, 10, "a", 80.0, 81.0, "a", 1500.0, 80.0, 81.0, 200.0, "FINALIZED")
    stores.append(spark.createDataFrame([row], FINAL_RECORD), path)
    seen, _ = jobs.drain(stores.new_rows(spark, path, FINAL_RECORD), "seen")
    assert [r["session_id"] for r in seen.collect()] == [10]
    more = spark.createDataFrame([(2, *row[1:]), (3, *row[1:])], FINAL_RECORD)
    stores.append(more, path)
    stores.delete_ids(more.where("id = 2"), path)
    seen, _ = jobs.drain(stores.new_rows(spark, path, FINAL_RECORD), "seen")
    assert sorted(r["id"] for r in seen.collect()) == [1, 2, 3]  # each once, rewritten or not


def test_raw_filter_reaches_the_scan(spark):
    path = scratch(spark, "raw")
    df = spark.range(10).select("id", F.col("id").alias("session_id"), F.col("id").alias("sample_id"), F.lit("t").alias("timestamp"), *[F.lit(1.0).alias(c) for c in ("left_pupil_px", "right_pupil_px")], F.lit("D").alias("left_status"), F.lit("D").alias("right_status"), F.lit(0.0).alias("perf_timestamp_ms"))
    stores.append(df, path)
    plan = stores.read_raw(spark, path).where("session_id = 7").select("left_pupil_px")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,7)" in plan and "ReadSchema: struct<session_id:bigint,left_pupil_px:double>" in plan


def test_csv(spark):
    path = scratch(spark, "csv")
    df = spark.createDataFrame([("S1", "P1", 0.1, 1, 82.0, None, 0.42)], "session_id string, subject_id string, time double, stimulus int, left_pupil_px double, right_pupil_px double, brightness double")
    exports.write_csv(df, path)
    assert exports.read_session_csv(spark, path).collect() == df.collect()


def test_require_valid_fails_the_job(spark):
    ok = spark.createDataFrame([(1, True)], "sample long, is_valid boolean")
    assert audit.require_valid(ok).count() == 1
    with pytest.raises(Exception, match="invalid sample 2"):
        audit.require_valid(spark.createDataFrame([(2, False)], "sample long, is_valid boolean")).collect()


def test_near_hashes_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    left = [rnd.getrandbits(64) for _ in range(60)]
    right = [h ^ sum(1 << b for b in rnd.sample(range(64), k)) for h in left for k in (0, 1, 2, 3)] + [rnd.getrandbits(64) for _ in range(100)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = lambda v: spark.createDataFrame([(signed(h),) for h in sorted(set(v))], "dhash long")
    for d in (0, 1, 2, 3):
        got = sorted((r[0], r[1], r[2]) for r in audit.near_hashes(table(left), table(right), d).collect())
        want = sorted((signed(a), signed(b), bin(a ^ b).count("1")) for a in set(left) for b in set(right) if bin(a ^ b).count("1") <= d)
        assert got == want


def test_near_leaks_with_copies_and_equal_hashes(spark):
    """A third of all samples share one content; another hash holds many different contents."""
    rows = [("val" if i % 3 else "train", i, 7, "same") for i in range(300)] + [("val" if i % 2 else "train", 1000 + i, 6, f"m{i}") for i in range(60)]
    hashed = spark.createDataFrame(rows, "split string, sample long, dhash long, md5 string")
    got = {(r["val_hash"], r["train_hash"]): r["pairs"] for r in audit.near_leaks(hashed).collect()}
    want = {}
    for s, _, h, m in rows:
        for s2, _, h2, m2 in rows:
            if s == "val" and s2 == "train" and m != m2 and bin(h ^ h2).count("1") <= 2:
                want[h, h2] = want.get((h, h2), 0) + 1
    assert got == want


def test_light_and_geometry_are_repeatable(spark):
    px = spark.createDataFrame([("t", s, y, x, float(20 * y + x)) for s in range(3) for y in range(8) for x in range(8)], "split string, sample long, y int, x int, lum double")
    run = lambda n: sorted(tuple(r) for r in pixels.adjust_light(px.repartition(n), pixels.random_factor(1, 0.9, 1.1), pixels.random_factor(2, 0.9, 1.1), 0.02, 5).select("sample", "y", "x", F.round("lum", 9)).collect())
    assert run(1) == run(5)
    same = pixels.remap(px, "lum", (8, 8), F.lit(False), F.lit(0.0), F.lit(0), F.lit(0))
    assert sorted(map(tuple, same.select(*px.columns).collect())) == sorted(map(tuple, px.collect()))
    shifted = {(r["sample"], r["y"], r["x"]): r["lum"] for r in pixels.remap(px, "lum", (8, 8), F.lit(False), F.lit(0.0), F.lit(2), F.lit(-1)).collect()}
    assert shifted[0, 0, 2] == 20.0 and shifted[0, 7, 3] == 0.0 and shifted[0, 0, 1] == 0.0
    for moved in ("nearest", "bilinear"):
        out = pixels.remap(px, "lum", (8, 8), F.lit(False), F.lit(0.0), F.lit(1), F.lit(1), moved).select(*px.columns)
        assert sorted(map(tuple, out.collect())) == sorted(("t", s, y, x, float(20 * (y - 1) + x - 1) if y and x else 0.0) for s in range(3) for y in range(8) for x in range(8))
    turned = {(r["y"], r["x"]): r["lum"] for r in pixels.remap(px.where("sample = 0"), "lum", (8, 8), F.lit(False), F.lit(90.0), F.lit(0), F.lit(0)).collect()}
    assert turned[0, 0] == 7.0 and turned[7, 0] == 0.0 and turned[0, 7] == 147.0


@pytest.mark.parametrize("name", ["delete_then_reinsert", "clear_store", "dedup_insert", "publish_rows"])
def test_several_writes_compute_the_records_once(spark, sf, monkeypatch, name):
    from reflexgrid.plans.catalog import QUERIES

    read = []
    insert = stores.insert_finals

    def watched(new, store):
        read.extend(new.inputFiles())
        insert(new, store)

    monkeypatch.setattr(stores, "insert_finals", watched)
    QUERIES[name](spark, sf)
    assert read and not [f for f in read if "events" in f]


def test_a_write_makes_no_file_per_task_and_bucket(spark, tmp_path):
    rows = spark.range(4000).repartition(8).select("id", F.col("id").alias("session_id"))
    stores.append(rows, str(tmp_path))
    assert len(list(tmp_path.glob("records/*/*/*/*.parquet"))) <= stores.BUCKETS
    assert spark.read.parquet(f"{tmp_path}/records").count() == 4000
