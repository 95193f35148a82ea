"""Connected components of links, and joins with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

BROADCAST_ROWS = 2_000_000


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small`, a table of a few narrow columns, with a broadcast hint if it has at most `rows` rows; larger ones are shuffled."""
    return F.broadcast(small) if small.count() <= rows else small


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Each round takes every node to that node of its neighbourhood, itself included, whose hash of node and round is least, and contracts the links.
    Stars vanish in one round, and paths shrink by a constant factor in whatever order their nodes are numbered. Rounds are written
    tables, so a lost executor costs the running round only.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, turn = None, 0
    while edges.take(1):
        rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("hash"), F.col(c).alias("node"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.least(F.min(rank("a")), F.min(rank("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(best["node"].alias("to")), "step")
        if labels is None:
            now = step.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(step.withColumnRenamed("node", "component"), "component", "left")
            now = moved.select("node", F.coalesce("to", "component").alias("component"))
        now = written(now, "labels")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        right = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        further = written(right.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        drop(edges, step, *([] if labels is None else [labels]))
        edges, labels, turn = further, now, turn + 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(checked(least), "component").select("node", F.col("least").alias("component"))
