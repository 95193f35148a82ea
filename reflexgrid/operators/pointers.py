"""Chains of rows: each kept row points to the first row at or after its time plus an interval.

Inside a batch pointers are found by binary search and followed by doubling: the reached set grows by the jump, the jump is squared.
A series passes a threshold from one batch to the next (the time from which a row is kept again), so a task holds one batch.

A hot series is cut into chunks. To a chunk the threshold in is at most its first time plus the interval, so only the rows up to
there can be entered, and the chunk is a short step function: entry time -> threshold out. Step functions are composed in a tree of
`FAN` chunks a node; then every chunk knows its own threshold and all chunks are marked at once. The number of jobs grows
with the logarithm (base FAN) of the number of chunks, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import changes, written
from .ordered import Layout

FAN = 256
OPEN = float("-inf")


def followers(t: np.ndarray, interval: float) -> np.ndarray:
    """For every row of ascending times the first row that is later by `interval`; len(t) if there is none."""
    after = np.searchsorted(t, t + interval)
    # t + interval is rounded; the rule is on the difference
    n = len(t)
    early = (after > 0) & (t[np.maximum(after - 1, 0)] - t >= interval)
    late = (after < n) & (t[np.minimum(after, n - 1)] - t < interval)
    while early.any() or late.any():
        after = after - early + late
        early = (after > 0) & (t[np.maximum(after - 1, 0)] - t >= interval)
        late = (after < n) & (t[np.minimum(after, n - 1)] - t < interval)
    return after


def reached(after: np.ndarray, start: int) -> np.ndarray:
    """Rows on the chain from `start`, by pointer doubling."""
    n = len(after)
    chain = np.array([start] if start < n else [], np.int64)
    jump = np.append(after, n)
    while len(chain):
        further = jump[chain]
        further = further[further < n]
        if not len(further):
            break
        chain = np.concatenate([chain, further])
        jump = jump[jump]
    return chain


def last_of(after: np.ndarray) -> np.ndarray:
    """For every row the last one on its chain."""
    own = np.arange(len(after))
    jump = np.where(after < len(after), after, own)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


class Steps:
    """The step function of a chunk or of a run of chunks: thresholds up to `at[i]` leave as the kept time `out[i]` (a threshold is given by the
    kept time it follows from); later ones pass unchanged. Both rise; of the entries with one `out` only the last is held, so few are left
    once chains have met, and a lookup is a binary search."""

    def __init__(self, first: float, at: np.ndarray, out: np.ndarray):
        self.first, self.at, self.out = first, np.asarray(at, np.float64), np.asarray(out, np.float64)

    @staticmethod
    def of(t: np.ndarray, interval: float) -> Steps:
        times, rows = np.unique(t, return_index=True)
        # of the entries up to the first time plus the interval, and the next one
        many = int(np.sum(times - times[0] < interval)) + 1
        last = last_of(followers(t, interval))
        return Steps(float(times[0]), times[:many], t[last[rows[:many]]]).short()

    def short(self) -> Steps:
        ends = np.append(self.out[1:] != self.out[:-1], True)
        return Steps(self.first, self.at[ends], self.out[ends])

    def all(self, kept: np.ndarray, interval: float) -> np.ndarray:
        """What each of the kept times leaves as."""
        n = len(self.at)
        place = np.searchsorted(self.at, kept + interval)
        while True:  # kept + interval is rounded; the rule is on the difference
            early = (place > 0) & (self.at[np.maximum(place - 1, 0)] - kept >= interval)
            late = (place < n) & (self.at[np.minimum(place, n - 1)] - kept < interval)
            if not (early.any() or late.any()):
                break
            place = place - early + late
        return np.where(place < n, self.out[np.minimum(place, n - 1)], kept)

    def __call__(self, kept: float, interval: float) -> float:
        return float(self.all(np.array([kept]), interval)[0])

    @staticmethod
    def joined(run: list[Steps], interval: float) -> Steps:
        at, out = np.zeros(0), np.zeros(0)
        entered = False  # whether no threshold passes the chunks so far
        for f in run:
            out = f.all(out, interval)
            if not entered:
                at, out = np.concatenate([at, f.at]), np.concatenate([out, f.out])
                entered = bool(f.at[-1] - run[0].first >= interval)
        return Steps(run[0].first, at, out).short()


# ---- on Spark


def _columns(layout: Layout) -> list[str]:
    return list(dict.fromkeys([*layout.keys, layout.chunk]))


def spaced(df: DataFrame, layout: Layout, time: str, interval: float, fan: int = FAN) -> DataFrame:
    """Keep a row when at least `interval` has passed since the last kept row of its series; the first row is kept, rows without a time
    are not."""
    timed = df.where(F.col(time).isNotNull())
    if not layout.chunk:
        return _marked(timed, list(layout.keys), list(layout.order), time, interval)
    parts = _columns(layout)
    return _marked(timed.join(thresholds(timed, layout, time, interval, fan), parts), parts, list(layout.order), time, interval, "_kept").drop("_kept")


def _marked(df: DataFrame, parts: list[str], order: list[str], time: str, interval: float, given: str | None = None) -> DataFrame:
    run = partial(_mark, parts=parts, time=time, interval=interval, given=given)
    return df.repartition(*parts).sortWithinPartitions(*parts, *order).mapInArrow(run, df.schema)


def _mark(batches: Iterator[pa.RecordBatch], parts: list[str], time: str, interval: float, given: str | None) -> Iterator[pa.RecordBatch]:
    series, kept = None, OPEN
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column(time).cast(pa.float64()).to_numpy(zero_copy_only=False)
        cuts = changes(batch, parts)
        keep = []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            own = tuple(batch.column(c)[a].as_py() for c in parts)
            if own != series:
                series, kept = own, OPEN
                if given is not None and (v := batch.column(given)[a].as_py()) is not None:
                    kept = v
            part = t[a:b]
            start = 0 if kept == OPEN else int(np.searchsorted(part - kept, interval))
            chain = reached(followers(part, interval), start)
            if len(chain):
                keep.append(a + np.sort(chain))
                kept = float(part[chain.max()])
        if keep:
            yield batch.take(pa.array(np.concatenate(keep)))


def thresholds(df: DataFrame, layout: Layout, time: str, interval: float, fan: int = FAN) -> DataFrame:
    """(keys, chunk, _kept): the last kept time before each chunk of a hot series; null before the first."""
    keys, parts = list(layout.keys), _columns(layout)
    light = df.select(*parts, F.col(time).cast("double").alias("_t"))

    def summary(table: pa.Table) -> pa.Table:
        steps = Steps.of(np.sort(table.column("_t").to_numpy()), interval)
        return _row(table, parts, steps)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    steps = "_first double, _at array<double>, _out array<double>"
    one = light.groupBy(*parts).applyInArrow(summary, ", ".join(f"`{c}` {kinds[c]}" for c in parts) + ", " + steps)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(layout.chunk)) - 1
    levels = [written(one.withColumn("_i", place.cast("long")), "steps")]

    def join_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        run = [Steps(*v) for v in zip(*(table.column(c).to_pylist() for c in ("_first", "_at", "_out")), strict=True)]
        return _row(table, [*keys, "_g"], Steps.joined(run, interval))

    names = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    while levels[-1].where("_i > 0").take(1):
        grouped = levels[-1].withColumn("_g", F.floor(F.col("_i") / fan)).groupBy(*keys, "_g")
        levels.append(written(grouped.applyInArrow(join_up, f"{names}, _g bigint, {steps}").withColumnRenamed("_g", "_i"), "steps"))

    def pass_down(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        kept = table.column("_kept")[0].as_py()
        kept, given = OPEN if kept is None else kept, []
        for v in zip(*(table.column(c).to_pylist() for c in ("_first", "_at", "_out")), strict=True):
            given.append(None if kept == OPEN else kept)
            kept = Steps(*v)(kept, interval)
        return table.select([*keys, "_i"]).append_column("_kept", pa.array(given, pa.float64()))

    given = levels[-1].select(*keys, "_i", F.lit(None).cast("double").alias("_kept"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("_g", F.floor(F.col("_i") / fan))
        down = child.join(given.withColumnRenamed("_i", "_g"), [*keys, "_g"])
        given = down.groupBy(*keys, "_g").applyInArrow(pass_down, f"{names}, _i bigint, _kept double")
    return levels[0].select(*parts, "_i").join(given, [*keys, "_i"]).drop("_i")


def _row(table: pa.Table, names: list[str], steps: Steps) -> pa.Table:
    first = table.slice(0, 1).select(names)
    doubles = pa.list_(pa.float64())
    out = {"_first": pa.array([steps.first]), "_at": pa.array([steps.at.tolist()], doubles), "_out": pa.array([steps.out.tolist()], doubles)}
    for name, values in out.items():
        first = first.append_column(name, values)
    return first
