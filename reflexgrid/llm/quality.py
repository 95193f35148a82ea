"""Quality scores: hashed word n-grams, logistic regression learned by follow-the-regularised-leader, sparse dot products to score.

Words are runs of letters and digits, and runs of other non-space characters. A word equal to the one before it is replaced by a mark
for repetition, so that repeated text has n-grams of its own. Features are the shares of each hashed 1- and 2-gram among all n-grams.

Defined results: null and empty texts have no features and get the score of the bias; without labelled rows of both classes the
model is the constant share of label 1 (0.5 without any); repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import Recent, held, map_rows, texts

WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BITS = 20
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
AGAIN = np.uint64(0xC2B2AE3D27D4EB4F)
SHIFT = np.uint64(64 - BITS)


def _hash(word: str) -> int:
    data = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)


def _hashes() -> Recent:
    return held("hashes", lambda: Recent(_hash))


def grams(text: str) -> np.ndarray:
    """Hashed places of all 1- and 2-grams, repeats included."""
    words = WORD.findall(text)
    h = np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) > 1:
        again = np.r_[False, h[1:] == h[:-1]]
        h[again] = AGAIN
    pairs = (h[:-1] * MULTIPLY ^ h[1:]) * AGAIN
    return np.concatenate([h * MULTIPLY, pairs]) >> SHIFT


@dataclass
class Model:
    weights: np.ndarray  # float32, 2 ** BITS
    bias: float
    scale: float

    def score(self, text: str) -> float:
        at = grams(text)
        value = self.bias + (self.scale * float(self.weights[at].sum(dtype=np.float64)) / len(at) if len(at) else 0.0)
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02, scale: float = 20.0) -> Model:
    """FTRL-proximal over (label, places, shares); rows come in an order given by their content, classes weigh the same."""
    if not rows or len({label for label, *_ in rows}) < 2:
        share = np.clip(np.mean([label for label, *_ in rows]), 0.02, 0.98) if rows else 0.5
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))), scale)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = sorted(range(len(rows)), key=lambda i: zlib.crc32(rows[i][1].tobytes() + rows[i][2].tobytes()))
    ones = sum(label for label, *_ in rows)
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}

    def solved(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in order:
            label, at, share = rows[i]
            at, x = np.r_[at, 1 << BITS], np.r_[share * scale, 1.0]
            w = solved(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * weight[label] * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = solved(z, n)
    return Model(w[:-1].astype(np.float32), float(w[-1]), scale)


def train(sample: DataFrame) -> Model:
    """Fit on a bounded sample of (label, text); executors make the features, the driver gets the distinct n-grams of each row."""

    def each(labels: list, batch: list[str]) -> dict:
        out: dict = {"label": labels, "places": [], "shares": []}
        for t in batch:
            at, many = np.unique(grams(t), return_counts=True)
            out["places"].append(at.astype(np.int32).tobytes())
            out["shares"].append((many / max(1, many.sum())).astype(np.float32).tobytes())
        return out

    rows = map_rows(sample.select("label", "text"), "label int, places binary, shares binary", each).collect()
    return fit([(r["label"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["shares"], np.float32).astype(float)) for r in rows])


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1, higher: label 1 likelier). The model is 4 MB whatever the corpus."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def each(keys: list, batch: list[str]) -> dict:
        m = shared.value
        return {"key": keys, "score": [m.score(t) for t in batch]}

    rows = texts(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, score double", each).withColumnRenamed("key", key)
