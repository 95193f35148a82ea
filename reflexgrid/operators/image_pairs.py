"""Metrics of image pairs from whole images: each image is one row (split, sample, lum, cls) with its values as bytes.

A pair is worked on where the image with more partners is: that image goes once to every block of at most `block` partners, its partners
go to their block. So an image with very many partners is dealt over many tasks, and a task holds one image and one block of
partners. Sums and cross products are taken on the arrays; no pixel becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32
FIELDS = ("mae", "rmse", "max_diff", "pearson", "iou", "dice")


def compared(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple:
    """(mae, rmse, largest difference, correlation, IoU, Dice) of two images and their class masks; the correlation of a flat image is null."""
    d = np.abs(a - b)
    n = len(a)
    pearson = None
    if n and a.min() < a.max() and b.min() < b.max():
        da, db = a - a.mean(), b - b.mean()
        pearson = float((da * db).sum() / np.sqrt((da * da).sum() * (db * db).sum()))
    both, any_, each = int((in_a & in_b).sum()), int((in_a | in_b).sum()), int(in_a.sum() + in_b.sum())
    if not n:
        return (None, None, None, None, 0.0, 0.0)
    return (float(d.mean()), float(np.sqrt((d * d).mean())), float(d.max()), pearson, both / max(any_, 1), 2.0 * both / max(each, 1))


def dealt(pairs: DataFrame, block: int) -> DataFrame:
    """(pair_a, pair_b, on_a, anchor, partner, blk): which image of each pair is sent once per block, and the block of its partner."""
    many = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"_n_{c}"))
    counted = pairs.join(many("pair_a"), "pair_a").join(many("pair_b"), "pair_b")
    on_a = F.col("_n_pair_a") >= F.col("_n_pair_b")
    size = F.when(on_a, F.col("_n_pair_a")).otherwise(F.col("_n_pair_b"))
    anchor, partner = F.when(on_a, F.col("pair_a")).otherwise(F.col("pair_b")), F.when(on_a, F.col("pair_b")).otherwise(F.col("pair_a"))
    blk = F.pmod(F.xxhash64(partner), F.ceil(size / block).cast("long"))
    return counted.select("pair_a", "pair_b", on_a.alias("on_a"), anchor.alias("anchor"), partner.alias("partner"), blk.alias("blk"))


def pair_metrics(pairs: DataFrame, images: DataFrame, splits: tuple[str, str] = ("val", "train"), cls: int = 2, kind: str = "<f8", block: int = BLOCK) -> DataFrame:
    """(pair_a, pair_b, mae, rmse, max_diff, pearson, iou, dice) of the pairs (pair_a, pair_b), sample ids of the two splits; `lum` holds
    numbers of the type `kind`, `cls` a byte per pixel. Pairs without one of their images, or of unequal size, give no row."""
    deal = dealt(pairs.distinct(), block)
    split = F.when(F.col("on_a"), splits[0]).otherwise(splits[1])
    other = F.when(F.col("on_a"), splits[1]).otherwise(splits[0])
    seen = images.select(F.col("split").alias("_split"), F.col("sample").alias("_sample"), "lum", "cls")
    anchors = deal.select("on_a", "anchor", "blk", split.alias("_split")).distinct().join(seen.withColumnRenamed("_sample", "anchor"), ["anchor", "_split"])
    partners = deal.select("pair_a", "pair_b", "on_a", "anchor", "blk", F.col("partner"), other.alias("_split")).join(seen.withColumnRenamed("_sample", "partner"), ["partner", "_split"])

    def work(one: pa.Table, many: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("pair_a", "pair_b", *FIELDS)}
        if one.num_rows:
            a, ca = np.frombuffer(one.column("lum")[0].as_py(), kind).astype(float), np.frombuffer(one.column("cls")[0].as_py(), np.uint8) == cls
            for i in range(many.num_rows):
                b, cb = np.frombuffer(many.column("lum")[i].as_py(), kind).astype(float), np.frombuffer(many.column("cls")[i].as_py(), np.uint8) == cls
                if len(a) != len(b):
                    continue
                first, second = ((a, ca), (b, cb)) if many.column("many_on_a")[i].as_py() else ((b, cb), (a, ca))
                values = compared(first[0], second[0], first[1], second[1])
                for c in ("pair_a", "pair_b"):
                    out[c].append(many.column(c)[i].as_py())
                for c, v in zip(FIELDS, values, strict=True):
                    out[c].append(v)
        types = [many.schema.field(c).type for c in ("pair_a", "pair_b")] + [pa.float64()] * len(FIELDS)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"pair_a {kinds['pair_a']}, pair_b {kinds['pair_b']}, " + ", ".join(f"{c} double" for c in FIELDS)
    group = ["on_a", "anchor", "blk"]
    fresh = lambda df, side, rest: df.select(*[F.col(c).alias(f"{side}_{c}") for c in group], *[F.col(c).alias(c) for c in rest]).groupBy(*[f"{side}_{c}" for c in group])
    return fresh(anchors, "one", ["lum", "cls"]).cogroup(fresh(partners, "many", ["pair_a", "pair_b", "lum", "cls"])).applyInArrow(work, schema)
