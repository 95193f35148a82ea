"""Evaluation measures of segmentation and classification, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import IMAGE
from .masks import class_geometry
from .ranks import running_total

CLASSES = 4
# Smoothing and guard terms of the losses, boost of the pupil class.
DICE_SMOOTH = 1e-5
LOG_EPS = 1e-7
PUPIL_BOOST = 2.0


def class_weights(counts: DataFrame, strategy: str = "inverse_sqrt") -> DataFrame:
    """Weights per class from (class, pixels), scaled to sum to the number of classes.

    The input is one row per class, so both sums run over that handful of rows.
    """
    total = counts.agg(F.sum("pixels")).scalar()
    freq = F.greatest(F.lit(1e-6), F.col("pixels") / total)
    raw = {"inverse_sqrt": F.lit(1.0) / F.sqrt(freq), "inverse_freq": F.lit(1.0) / freq, "uniform": F.lit(1.0)}[strategy]
    rows = counts.select("class", raw.alias("_raw"))
    scale = rows.agg((F.count(F.lit(1)) / F.sum("_raw")).alias("s")).scalar()
    return rows.select("class", (F.col("_raw") * scale).alias("weight"))


def class_scores(logits: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """One row per pixel: softmax probability of each class (p0..p3) and the true class."""
    wide = logits.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("class") == c, F.col("logit"))).alias(f"l{c}") for c in range(CLASSES)])
    top = F.greatest(*[F.col(f"l{c}") for c in range(CLASSES)])
    exps = [F.exp(F.col(f"l{c}") - top) for c in range(CLASSES)]
    total = exps[0] + exps[1] + exps[2] + exps[3]
    return wide.join(targets.select(*keys, "y", "x", F.col("class").alias("target")), [*keys, "y", "x"]).select(
        *keys, "y", "x", "target", *[(e / total).alias(f"p{c}") for c, e in enumerate(exps)]
    )


def losses(scores: DataFrame, weights: tuple[float, ...], boost: float = PUPIL_BOOST, pupil: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted cross entropy, soft Dice and their sum, per group or over the whole batch."""
    hit = lambda c: F.col("target") == c
    p = lambda c: F.col(f"p{c}")
    aggs = []
    for c in range(CLASSES):
        aggs += [
            F.sum(F.when(hit(c), -F.ln(p(c) + F.lit(LOG_EPS)))).alias(f"n{c}"), F.count(F.when(hit(c), 1)).alias(f"t{c}"),
            F.sum(p(c)).alias(f"s{c}"), F.sum(F.when(hit(c), p(c)).otherwise(F.lit(0.0))).alias(f"i{c}"),
        ]
    g = scores.groupBy(*by).agg(*aggs)
    zero = F.lit(0.0)

    def total(parts: list[Column]) -> Column:
        acc = parts[0]
        for part in parts[1:]:
            acc = acc + part
        return acc

    nll = total([F.coalesce(F.col(f"n{c}"), zero) * F.lit(weights[c]) for c in range(CLASSES)])
    mass = total([F.col(f"t{c}") * F.lit(weights[c]) for c in range(CLASSES)])
    dw = [w * boost if c == pupil else w for c, w in enumerate(weights)]
    smooth = F.lit(DICE_SMOOTH)
    dice = [F.lit(1.0) - (F.lit(2.0) * F.col(f"i{c}") + smooth) / (F.col(f"s{c}") + F.col(f"t{c}") + smooth) for c in range(CLASSES)]
    out = g.select(
        *by, (nll / F.greatest(F.lit(1.0), mass)).alias("loss_ce"), (total([d * F.lit(w) for d, w in zip(dice, dw)]) / F.lit(sum(dw))).alias("loss_dice")
    )
    return out.withColumn("loss_total", F.col("loss_ce") + F.col("loss_dice"))


def size_errors(truth: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Diameter, centre and pupil/iris ratio error per image with a pupil in both masks."""
    geo = lambda df, cls, p: class_geometry(df, cls, keys).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("area", "cx", "cy")])
    k = list(keys)
    rows = geo(truth, 2, "tp").join(geo(truth, 3, "ti"), k).join(geo(predicted, 2, "pp"), k).join(geo(predicted, 3, "pi"), k)
    rows = rows.where("tp_area > 0 and pp_area > 0")
    d = lambda c: F.lit(2.0) * F.sqrt(F.col(c) / F.lit(math.pi))
    dx, dy = F.col("pp_cx") - F.col("tp_cx"), F.col("pp_cy") - F.col("tp_cy")
    ratio = lambda p: F.sqrt(F.col(f"{p}p_area") / F.nullif(F.col(f"{p}i_area"), F.lit(0)))
    return rows.select(
        *keys, (F.abs(d("pp_area") - d("tp_area")) / d("tp_area") * 100).alias("diameter_error_pct"), F.sqrt(dx * dx + dy * dy).alias("centre_error_px"),
        (F.abs(ratio("p") - ratio("t")) / ratio("t") * 100).alias("iris_ratio_error_pct"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """Counts and rates from (label, predicted), both 0/1."""
    n = lambda l, p: F.count_if((F.col("label") == l) & (F.col("predicted") == p))  # noqa: E731, E741
    g = scored.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: a / F.nullif(b, F.lit(0))
    return g.select(
        "*", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
        div(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve from (label, score): counts per score first, then running sums over ranges of the score."""
    by_score = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    run = running_total(by_score, ["score"], "neg", "_below")
    wins = F.col("pos") * (F.col("_below") - F.col("neg") + F.col("neg") / 2)
    return run.agg(F.sum(wins).alias("w"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).select(
        "positives", "negatives", (F.col("w") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc")
    )
