"""Dark-region search: tasks of a bounded number of rows, each step planned once, and the component of a seed."""

import pytest
from compare import spark_rows
from pyspark.sql import functions as F
from test_masks import flood, shapes

from reflexgrid.operators import components, pixels
from reflexgrid.plans import fixtures as fx
from reflexgrid.plans.catalog import QUERIES, images


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_do_not_grow_with_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(components, "TASK_ROWS", 500, raising=False)
    thumbs = fx.thumbs(spark, sf)
    many = thumbs.select("split", "sample").distinct().count()
    assert many > 300
    assert most_in_a_task(pixels.blur(thumbs)) < 36 * many / 10  # 36 inner pixels an image
    iris, cuts, region = images._region(spark, sf)
    disc = images._disc(spark, sf)[1]
    for per_image in (pixels.dark_seed(disc), pixels.adaptive_threshold(disc)):
        assert most_in_a_task(per_image) < many / 5
    assert most_in_a_task(pixels.judge_region(pixels.region_moments(region), iris, cuts)) < many / 5


def test_semi_joins_follow_the_numbered_exchange(spark, sf, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return components.written(df, name)

    monkeypatch.setattr(pixels, "written", kept)
    images._region(spark, sf)
    for side in plans["region"].split("SortMergeJoin")[1:]:
        assert "LeftSemi" in side and "REPARTITION_BY_NUM" in side
    assert "Exchange" not in plans["region"].split("SortMergeJoin")[0]


def test_task_size_does_not_change_the_result(spark, sf, monkeypatch):
    want = {n: spark_rows(QUERIES[n](spark, sf)) for n in ("pupil_detect", "region_grow", "region_moments")}
    monkeypatch.setattr(components, "TASK_ROWS", 700, raising=False)
    for name, rows in want.items():
        assert spark_rows(QUERIES[name](spark, sf)) == rows


def test_each_step_is_planned_once(spark, sf):
    iris, cuts, region = images._region(spark, sf)
    for df in (iris, cuts, region, images._disc(spark, sf)[1]):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [250_000, 40])
def test_component_of_a_seed(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "TASK_ROWS", rows)
    px = shapes(spark).where("sample < 6 and sample <> 0")
    seeds = {1: (119, 149), 2: (21, 2), 3: (9, 9), 4: (5, 5), 5: (38, 7)}
    at = spark.createDataFrame([("t", n, y, x) for n, (y, x) in seeds.items()], px.schema)
    runs = components.component_runs_of(px, at)
    got = {}
    for r in components.to_pixels(runs).collect():
        got.setdefault(r["sample"], set()).add((r["y"], r["x"]))
    for n, seed in seeds.items():
        image = [[0] * 150 for _ in range(120)]
        for r in px.where(F.col("sample") == n).collect():
            image[r["y"]][r["x"]] = 1
        label, _ = flood(image)
        assert got[n] == {p for p, first in label.items() if first == label[seed]}
    assert {r["sample"]: r["n"] for r in runs.select("sample", "n").distinct().collect()} == {n: len(p) for n, p in got.items()}
    missing = at.withColumn("x", F.col("x") + 500)  # a seed beside every run has no component
    assert components.component_runs_of(px, missing).isEmpty()
