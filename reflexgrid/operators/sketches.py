"""Approximate audit figures that can be kept and merged: counts of distinct values (HyperLogLog) and quantiles (KLL).

Sketches are made once per part of the data (a split and a day, say), kept as binary columns of a small table, and merged for any wider
grouping without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12  # 4,096 registers: a relative standard error of about 1.04 / 64
KLL_K = 200  # a rank error of about 1.33 %


def sketched(df: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """(keys, n, distinct_sketch, value_sketch) of the rows; `value` is a whole number, nulls are left out of the sketches."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(KLL_K)).alias("value_sketch")
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same table for fewer keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("value_sketch").alias("value_sketch"))


def figures(sketches: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(keys, n, distinct, one column per quantile) estimated from the sketches."""
    at = [F.kll_sketch_get_quantile_bigint("value_sketch", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), *at)
