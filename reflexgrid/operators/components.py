"""Connected regions of masks: 8-neighbour components over horizontal runs.

A run is a maximal horizontal stretch of pixels. Its id is its first pixel in line order; the label of
a component is the smallest id in it. Runs are labelled strip by strip; strips of one image are joined by the links across their seams,
whose components are found in written rounds. `bitmaps` does the same on binary images.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

IMAGE = ("split", "sample")
LINE = 1 << 32
TASK_ROWS = 250_000  # pixels or runs


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: ends the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, keys: Sequence[str], beside: DataFrame | None = None) -> DataFrame:
    """The rows dealt to tasks of about TASK_ROWS by their keys, or of as many rows of `beside`, a larger table they are joined with. An exchange
    without a number has its parts merged by their compressed size, and a pixel takes some bytes there but some hundred in a sort. Counts the
    rows, so they are best a given or written table. For a semi join deal its right side: the join is planned before an exchange on its left."""
    most = rows if beside is None else beside
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-most.count() // TASK_ROWS))
    return rows.repartition(tasks, *keys)


def to_runs(pixels: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Pixels (keys, y, x) to runs (keys, y, x0, x1, run); a line is one group, so groups stay small."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    marked = dealt(pixels.select(*keys, "y", "x"), [*keys, "y"]).select(*keys, "y", "x", (F.col("x") - F.row_number().over(line)).alias("_g"))
    runs = marked.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    return runs.withColumn("run", F.col("y").cast("long") * LINE + F.col("x0"))


def roots(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Position of the earliest run of its component for every run (runs in line order; lines of unlike images are no neighbours)."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    wide = int(x1.max()) + 4
    starts, ends = y * wide + x0 + 1, y * wide + x1 + 1
    # of the line above: from the first run that ends at x0 - 1 or later to the last that starts at x1 + 1 or before
    low = np.searchsorted(ends, (y - 1) * wide + x0, "left")
    high = np.maximum(np.searchsorted(starts, (y - 1) * wide + x1 + 2, "right"), low)
    many = high - low
    a = np.repeat(np.arange(n), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


def changes(batch: pa.RecordBatch | pa.Table, parts: list[str]) -> list[int]:
    """Rows at which a new group of equal `parts` starts; the first row is one."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in parts if n > 1 else []:
        a, b = batch.column(c).slice(0, n - 1), batch.column(c).slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= np.asarray(other.to_pylist(), bool) if isinstance(other, pa.ChunkedArray) else other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def _label_strips(batches: Iterator[pa.RecordBatch], parts: list[str], tile: int) -> Iterator[pa.RecordBatch]:
    """Label runs that arrive sorted by image, strip and line. Whole strips are labelled as they come; the last one waits for its rest."""
    waiting = None

    def labelled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        y, x0, x1, run = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "run"))
        cuts = np.array(changes(rows, parts))
        strip = np.searchsorted(cuts, np.arange(len(y)), "right")
        label = run[roots(strip * (tile + 2) + y % tile, x0, x1)]
        yield from rows.append_column("label", pa.array(label, pa.int64())).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
        cut = changes(rows, parts)[-1] if rows.num_rows else 0
        if cut:
            yield from labelled(rows.slice(0, cut))
        waiting = rows.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield from labelled(waiting)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the smallest node of the component. Each round takes a node to the one of its
    neighbourhood with the least hash and contracts the edges, so chains shrink by a constant factor however they are numbered."""
    edges = written(edges.where("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while edges.take(1):
        rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("hash"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("a")), F.min(rank("b")))["node"].alias("to")), "step")
        moved = step.select("node", F.col("to").alias("root")) if labels is None else labels.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = written(moved, "labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        edges = written(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("_least"))
    return labels.join(least, "root").select("node", F.col("_least").alias("root"))


def label_runs(runs: DataFrame, keys: tuple[str, ...] = IMAGE, tile: int = 1024) -> DataFrame:
    """Add `label`, the smallest run id of the component, to every run. Strips of `tile` lines are labelled on their own and joined at their
    seams, so a task holds one strip."""
    from .bitmaps import seamed

    nodes = written(runs, "runs")
    schema = T.StructType([*nodes.schema.fields, T.StructField("_strip", T.LongType()), T.StructField("label", T.LongType())])
    parts = [*keys, "_strip"]

    def local(df: DataFrame) -> DataFrame:
        cut = df.withColumn("_strip", F.floor(F.col("y") / tile))
        return dealt(cut, parts).sortWithinPartitions(*parts, "y", "x0").mapInArrow(partial(_label_strips, parts=parts, tile=tile), schema).drop("_strip")

    tall = nodes.where(F.col("y") >= tile).select(*keys).distinct()
    if tall.isEmpty():  # there is no seam
        return local(nodes)
    return seamed(local(nodes), local(nodes.join(tall, list(keys), "left_semi")), keys, tile)


def largest(labelled: DataFrame, keys: tuple[str, ...] = IMAGE, min_area: int = 10) -> DataFrame:
    """The label with the most pixels per image (first in line order on ties), if it is big enough."""
    area = labelled.groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    best = area.groupBy(*keys).agg(F.max("area").alias("area"), F.min_by("label", F.struct(-F.col("area"), F.col("label"))).alias("label"))
    return best.where(F.col("area") >= min_area)


def label_pixel(label) -> tuple:
    """(y, x) of the first pixel of a component."""
    return F.floor(label / LINE).cast("int"), (label % LINE).cast("int")


def to_pixels(runs: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def component_runs_of(pixels: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Runs (keys, y, x0, x1, n) of the component that holds the image's seed pixel (keys, y, x); n is its number of pixels."""
    at = seeds.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"))
    runs = dealt(written(label_runs(to_runs(pixels, keys), keys), "labelled"), keys).join(at.hint("merge"), list(keys))
    image = Window.partitionBy(*keys)
    hit = F.max(F.when((F.col("y") == F.col("_sy")) & F.col("_sx").between(F.col("x0"), F.col("x1")), F.col("label"))).over(image)
    own = runs.withColumn("_hit", hit).where(F.col("label") == F.col("_hit"))
    return own.select(*keys, "y", "x0", "x1", F.sum(F.col("x1") - F.col("x0") + 1).over(image).alias("n"))
