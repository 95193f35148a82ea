"""Exact positions in a global order without one sorted partition.

Rows are dealt into ranges of the order (Spark samples the borders), and the ranges are counted: one number per range goes to the driver. A wanted position
lies in one range, and only that range is sorted; running totals start from the sum of the ranges before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import written


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `_part`, the number of their range in the order."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def at_ranks(df: DataFrame, order: list[str], ranks: Callable[[int], list[int]]) -> DataFrame:
    """The rows at the positions `ranks(number of rows)`, counted from 0 in the order of `order` (a total one), with `k`, the place in that list."""
    rows = ranged(df, order)
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    wanted, below = [], 0
    places = ranks(sum(n for _, n in counts))
    for part, n in counts:
        wanted += [(k, part, p - below + 1) for k, p in enumerate(places) if below <= p < below + n]
        below += n
    if not wanted:
        return rows.where("false").drop("_part").withColumn("k", F.lit(0))
    spark = df.sparkSession
    inside = rows.where(F.col("_part").isin(sorted({p for _, p, _ in wanted})))
    numbered = inside.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # as many rows as there are wanted positions
    return numbered.join(F.broadcast(spark.createDataFrame(wanted, "k int, _part int, _place int")), ["_part", "_place"]).drop("_part", "_place")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add the inclusive running sum of `value` in the order of `order`."""
    rows = ranged(df, order)
    sums = sorted((r["_part"], r["s"]) for r in rows.groupBy("_part").agg(F.sum(value).alias("s")).collect())
    before, total = [], 0
    for part, s in sums:
        before.append((part, total))
        total += s or 0
    kind = rows.select(F.sum(value)).schema[0].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame(before, f"_part int, _before {kind}")
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, local).join(F.broadcast(offsets), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
