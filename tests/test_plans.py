"""The physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import audit, live
from reflexgrid.plans import fixtures as fx
from reflexgrid.plans.catalog import QUERIES


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_kinetics_shuffle_the_frames_once(spark, sf):
    p = plan(fx.recording(spark, sf).features())
    assert len(re.findall(r"\bExchange ", p)) == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


@pytest.mark.parametrize("name", ["leak_perceptual", "leak_review", "stimulus_interval", "asof_latest_b", "agreement_frames", "duplicate_members", "roc_auc", "linspace_pick", "representatives"])
def test_no_nested_loops(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_ring_buffers_limit_before_the_shuffle(spark, sf):
    df = live.newest(fx.table(spark, sf, "events"), ["event_type"], [F.col("event_id").desc()], 10)
    assert "WindowGroupLimit" in plan(df)


def test_newest_is_a_bounded_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["retention300"](spark, sf))


def test_resize_needs_no_shuffle(spark, sf):
    assert "Exchange" not in plan(QUERIES["resize_nearest"](spark, sf))


def test_duplicate_groups_combine_before_the_shuffle(spark, sf):
    df = fx.table(spark, sf, "documents").select(F.md5("text").alias("md5"), "doc_id", F.lit("a").alias("split"))
    p = plan(audit.duplicate_groups(df, "md5", "doc_id", ["split"]))
    assert "partial_count" in p and "collect" not in p


def test_tasks_of_a_recording_grow_with_its_frames(spark, sf, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 50)
    rows = fx.recording(spark, sf).clean()
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert rows.rdd.getNumPartitions() == -(-n // 50)
