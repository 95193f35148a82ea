"""Compression of vectors to codes by product codebooks, with equal-average search for the nearest entry.

Components become integers, `floor(scale * x)`; a vector is cut into equal consecutive parts and each part position has a codebook of
its own. A codebook starts with that part of the vectors of the smallest ids; a round assigns every part to its nearest entry and replaces each entry by the
floor of the mean of its parts.

Search. The squared gap of two component sums, divided by the dimension, never exceeds the squared distance (Cauchy-Schwarz). Entries
are sorted by their sum; the search starts where the part's own sum would stand and expands outward, always to the side with the smaller gap, until
the squared gap over the dimension strictly exceeds the best distance on both sides. An entry at the same distance wins by its
lower index, which is why the search goes on at equality. All parts of a batch take their steps together.

On Spark a round is one pass over the vectors: each task adds up count and component sums for every entry and batch, one small
aggregate merges them, and the codebooks (parts x entries x dimension numbers, whatever the size of the table) go out with the next pass.

Defined results: rows with a null vector, null components or non-finite ones are left out; a codebook has fewer entries if there are
fewer rows; null ids come last and equal ids are ordered by their vectors; vectors of unequal length are filled up with zeros to the
smallest multiple of `parts` that holds the longest. Components beyond `WIDE` in size are computed with unbounded integers; errors beyond the range of a long become its
largest value. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import checked

WIDE = 1 << 24  # below it, 2,048 squared differences stay within 64 bits, and so do the sums of a batch
LONGEST = (1 << 63) - 1


class Books:
    """Codebooks of all parts (lists of Python integers or an array), prepared for the search."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.parts, self.size, self.dim = len(entries), len(entries[0]), len(entries[0][0])
        flat = [abs(v) for part in entries for e in part for v in e]
        self.wide = max(flat, default=0) >= WIDE
        self.array = np.array(entries, dtype=object if self.wide else np.int64).reshape(self.parts, self.size, self.dim)
        self.order = [sorted(range(self.size), key=lambda e: (sum(part[e]), e)) for part in entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For every row of `x` its nearest entry, the squared distance, and (for all rows) how many distances were computed."""
        order = np.array(self.order[part])
        book = self.array[part][order]
        if x.dtype == object and book.dtype != object:
            book = book.astype(object)
        elif book.dtype == object and x.dtype != object:
            x = x.astype(object)
        sums, own = book.sum(axis=1), x.sum(axis=1)
        n = len(x)
        right = np.searchsorted(sums, own)
        left = right - 1
        best = np.full(n, -1, dtype=x.dtype)  # -1: nothing yet
        entry = np.full(n, self.size)
        rows, tried = np.arange(n), 0
        while len(rows):
            lo, hi = left[rows], right[rows]
            gap_lo = np.where(lo >= 0, own[rows] - sums[np.maximum(lo, 0)], -1)
            gap_hi = np.where(hi < self.size, sums[np.minimum(hi, self.size - 1)] - own[rows], -1)
            down = (gap_lo >= 0) & ((gap_hi < 0) | (gap_lo <= gap_hi))
            gap = np.where(down, gap_lo, gap_hi)
            # the nearer side has no entry left, or only ones that are too far: so has the other
            goes_on = (gap >= 0) & ((best[rows] < 0) | (gap * gap <= self.dim * best[rows]))
            rows, lo, hi, down = rows[goes_on], lo[goes_on], hi[goes_on], down[goes_on]
            at = np.where(down, lo, hi)
            apart = x[rows] - book[at]
            far = (apart * apart).sum(axis=1) if self.dim else np.zeros(len(rows), x.dtype)
            tried += len(rows)
            had, index = best[rows], order[at]
            better = (had < 0) | (far < had) | ((far == had) & (index < entry[rows]))
            best[rows[better]], entry[rows[better]] = far[better], index[better]
            left[rows[down]] -= 1
            right[rows[~down]] += 1
        return entry, best, tried


def usable(df: DataFrame, vector: str, extra: dict[str, str]) -> DataFrame:
    """(extra..., vector) of the rows whose vectors are whole and finite; components are doubles."""
    x = F.col(vector).cast("array<double>")
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN sorts above infinity
    return df.select(*[F.col(c).alias(name) for name, c in extra.items()], x.alias("vector")).where(fine)


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """The vectors of a batch as rows of `width` integers, floor(scale * x); Python's own integers if any is wide."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(flat * scale)
    if np.isinf(whole).any() or (len(whole) and np.abs(whole).max() >= WIDE):
        whole = np.array([_floor(v, scale) for v in flat.tolist()], dtype=object)
    else:
        whole = whole.astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return whole.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=whole.dtype)
    out[np.arange(width) < lengths[:, None]] = whole
    return out


def _floor(v: float, scale: int) -> int:
    top, bottom = v.as_integer_ratio()
    return top * scale // bottom


def _sums(batches: Iterator[pa.RecordBatch], books: Books, width: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Count and component sums of every entry over the task's rows."""
    counts = np.zeros((books.parts, books.size), np.int64)
    totals = np.zeros((books.parts, books.size, books.dim), dtype=object)
    for batch in batches:
        x = integers(batch.column("vector"), width, scale)
        for p in range(books.parts):
            part = x[:, p * books.dim : (p + 1) * books.dim]
            entry, _, _ = books.nearest(p, part)
            for e in np.unique(entry):
                counts[p, e] += (entry == e).sum()
                totals[p, e] += part[entry == e].sum(axis=0).astype(object)
    at = [(p, e) for p in range(books.parts) for e in range(books.size) if counts[p, e]]
    yield pa.record_batch(
        [
            pa.array([p for p, _ in at], pa.int32()),
            pa.array([e for _, e in at], pa.int32()),
            pa.array([counts[k] for k in at], pa.int64()),
            pa.array([[str(v) for v in totals[k]] for k in at], pa.list_(pa.string())),
        ],
        names=["part", "entry", "n", "sums"],
    )


def _round(vectors: DataFrame, books: Books, width: int, scale: int) -> Books:
    parts = vectors.select("vector").mapInArrow(partial(_sums, books=books, width=width, scale=scale), "part int, entry int, n bigint, sums array<string>")
    # one row per task, part and entry; decimals of 38 digits hold any sum of longs
    spread = parts.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).withColumn("v", F.col("v").try_cast("decimal(38,0)"))
    merged = spread.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.try_sum("v").alias("v"), F.count("v").alias("sized"), F.count("*").alias("rows"))
    entries = [[list(e) for e in part] for part in books.entries]
    for r in merged.collect():  # parts x entries x dimension numbers
        if r["sized"] < r["rows"] or r["v"] is None:
            raise OverflowError("sums of components have more than 38 digits")
        entries[r["part"]][r["entry"]][r["at"]] = int(r["v"]) // r["n"]
    return Books(entries)


def train(vectors: DataFrame, parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[Books, int] | None:
    """Codebooks of the (id, vector) rows and the width that vectors are filled up to; None for an empty table."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts) * parts
    first = vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(size).select("vector").toArrow()
    x = integers(first.column("vector"), width, scale)
    dim = width // parts
    books = Books([[[int(v) for v in row[p * dim : (p + 1) * dim]] for row in x] for p in range(parts)])
    for _ in range(rounds):
        books = _round(vectors, books, width, scale)
    return books, width


def _coded(batches: Iterator[pa.RecordBatch], books: Books, width: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = integers(batch.column("vector"), width, scale)
        found = [books.nearest(p, x[:, p * books.dim : (p + 1) * books.dim]) for p in range(books.parts)]
        codes = np.stack([e for e, _, _ in found], axis=1).astype(np.uint8).reshape(len(x), -1)
        errors = sum(d.astype(object) if d.dtype == object else d for _, d, _ in found)
        errors = [min(int(v), LONGEST) for v in errors]
        code = [row.tobytes().hex() for row in codes]
        yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])


def encode(vectors: DataFrame, books: Books, width: int, scale: int = 4096) -> DataFrame:
    """(id, label, code, error) of (id, label, vector) rows."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    return vectors.select("id", "label", "vector").mapInArrow(partial(_coded, books=books, width=width, scale=scale), schema)


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per usable vector: its code, its error, the errors of its label added up, and the digest of the codebooks. Codes have two
    hex digits a part, so `size` is at most 256."""
    vectors = written(usable(df, vector, {"id": id, "label": label}), "vectors")
    model = train(vectors, parts, size, rounds, scale)
    if model is None:
        coded, digest = vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), ""
    else:
        coded, digest = written(encode(vectors, *model, scale), "codes"), model[0].digest()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("bigint")
    per = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(checked(per), F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
