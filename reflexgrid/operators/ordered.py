"""Ordered operations on keyed series that stay parallel when one key is huge.

A ``Layout`` names the key, the total order and, for hot keys only, a chunk column that never
decreases along the order. Without a chunk every operation is one window over the key. With a
chunk the rows are partitioned by (key, chunk); what crosses a chunk border is computed from one
summary row per chunk, so no task ever sees a whole hot key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import HeatSettings

HALO = "_halo"


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str | None = None

    @property
    def parts(self) -> list[str]:
        return [*self.keys, self.chunk] if self.chunk else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _reverse(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*[F.col(c).desc() for c in self.order])

    def _chunks(self, descending: bool = False) -> WindowSpec:
        by = F.col(self.chunk).desc() if descending else F.col(self.chunk)
        return Window.partitionBy(*self.keys).orderBy(by)

    def _rank(self) -> Column:
        return F.struct(*self.order)

    # ---- bounded neighbourhoods -------------------------------------------------------------

    def extend(self, df: DataFrame, before: int, after: int) -> DataFrame:
        """Give every chunk copies of its neighbours' rows: `before` earlier and `after` later ones."""
        if not self.chunk:
            return df
        if not before and not after:
            return df.withColumn(HALO, F.lit(False))
        w = self.window()
        names = df.columns
        one = F.struct(*names)
        marked = df.select(
            *names,
            F.lag(F.lit(1), after).over(w).isNull().alias("_head") if after else F.lit(False).alias("_head"),
            F.lead(F.lit(1), before).over(w).isNull().alias("_tail") if before else F.lit(False).alias("_tail"),
        )
        edges = (
            marked.where("_head or _tail")
            .groupBy(*self.parts)
            .agg(
                F.collect_list(F.when(F.col("_head"), F.struct(self._rank().alias("o"), one.alias("r")))).alias("_h"),
                F.collect_list(F.when(F.col("_tail"), F.struct(self._rank().alias("o"), one.alias("r")))).alias("_t"),
            )
        )
        wc = self._chunks()
        parts = []
        if before:
            parts.append(F.slice(F.sort_array(F.flatten(F.collect_list("_t").over(wc.rowsBetween(-before, -1))), asc=False), 1, before))
        if after:
            parts.append(F.slice(F.sort_array(F.flatten(F.collect_list("_h").over(wc.rowsBetween(1, after)))), 1, after))
        halo = (
            edges.select(F.col(self.chunk).alias("_c"), F.concat(*parts).alias("_n"))
            .select("_c", F.explode("_n").alias("_n"))
            .select(*[F.col("_c").alias(c) if c == self.chunk else F.col(f"_n.r.{c}").alias(c) for c in names], F.lit(True).alias(HALO))
        )
        return df.withColumn(HALO, F.lit(False)).unionByName(halo)

    def trim(self, df: DataFrame) -> DataFrame:
        """Drop the copies that `extend` added."""
        return df.where(~F.col(HALO)).drop(HALO) if self.chunk else df

    # ---- unbounded look-back and look-ahead -------------------------------------------------

    def _carry(self, df: DataFrame, values: dict[str, tuple[Column, bool]]) -> DataFrame:
        """Per chunk, the nearest non-null value before (True) or after (False) the chunk."""
        work = df.select(*self.parts, *self.order, *[v.alias(f"_{n}") for n, (v, _) in values.items()])
        rank = self._rank()
        ends = work.groupBy(*self.parts).agg(
            *[
                (F.max_by if back else F.min_by)(F.col(f"_{n}"), F.when(F.col(f"_{n}").isNotNull(), rank)).alias(f"_{n}")
                for n, (_, back) in values.items()
            ]
        )
        frames = {
            True: self._chunks().rowsBetween(Window.unboundedPreceding, -1),
            False: self._chunks(descending=True).rowsBetween(Window.unboundedPreceding, -1),
        }
        return ends.select(
            *self.parts,
            *[F.last(f"_{n}", ignorenulls=True).over(frames[back]).alias(f"_carry_{n}") for n, (_, back) in values.items()],
        )

    def nearest(self, df: DataFrame, values: dict[str, tuple[Column, bool]], inclusive: bool = False) -> DataFrame:
        """Add the last non-null value before (True) or the first one after (False) each row."""
        end = 0 if inclusive else -1
        spans = {
            True: self.window().rowsBetween(Window.unboundedPreceding, end),
            False: self._reverse().rowsBetween(Window.unboundedPreceding, end),
        }
        near = {n: F.last(v, ignorenulls=True).over(spans[back]) for n, (v, back) in values.items()}
        if not self.chunk:
            return df.select("*", *[c.alias(n) for n, c in near.items()])
        carry = self._carry(df, values)
        return df.join(carry, self.parts).select(
            *df.columns, *[F.coalesce(c, F.col(f"_carry_{n}")).alias(n) for n, c in near.items()]
        )

    # ---- prefix aggregates ------------------------------------------------------------------

    def prefix(self, df: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
        """Add inclusive running sums or maxima: {name: ("sum" | "max", value)}."""
        fns = {"sum": F.sum, "max": F.max}
        span = self.window().rowsBetween(Window.unboundedPreceding, 0)
        local = {n: fns[kind](v).over(span) for n, (kind, v) in values.items()}
        if not self.chunk:
            return df.select("*", *[c.alias(n) for n, c in local.items()])
        totals = df.groupBy(*self.parts).agg(*[fns[kind](v).alias(f"_{n}") for n, (kind, v) in values.items()])
        before = self._chunks().rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*self.parts, *[fns[kind](f"_{n}").over(before).alias(f"_carry_{n}") for n, (kind, _) in values.items()])
        merged = []
        for n, (kind, _) in values.items():
            c = F.col(f"_carry_{n}")
            merged.append((local[n] + F.coalesce(c, F.lit(0)) if kind == "sum" else F.greatest(local[n], c)).alias(n))
        return df.join(carry, self.parts).select(*df.columns, *merged)

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """1-based position of each row in its series."""
        if not self.chunk:
            return df.withColumn(name, F.row_number().over(self.window()).cast("long"))
        return self.prefix(df, {name: ("sum", F.lit(1).cast("long"))})

    # ---- whole-series totals on every row ---------------------------------------------------

    def totals(self, df: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Attach aggregates of the whole series to each of its rows."""
        if not self.chunk:
            w = Window.partitionBy(*self.keys)
            return df.select("*", *[v.over(w).alias(n) for n, v in values.items()])
        sums = df.groupBy(*self.keys).agg(*[v.alias(n) for n, v in values.items()])
        return df.join(sums, list(self.keys))


@dataclass(frozen=True)
class Heat:
    """Which values of `key` have more rows than one task should take."""

    key: str
    hot: DataFrame | None = None
    settings: HeatSettings = HeatSettings()

    @staticmethod
    def measure(df: DataFrame, source_key: str, key: str | None = None, settings: HeatSettings = HeatSettings()) -> Heat:
        """Count rows per key (one pruned column, combined map-side) and keep the hot keys, if any."""
        key = key or source_key
        counts = df.groupBy(F.col(source_key).alias(key)).count()
        hot = counts.where(F.col("count") > settings.max_rows).select(key)
        found = len(hot.take(settings.broadcast_keys + 1))
        if not found:
            return Heat(key, None, settings)
        return Heat(key, F.broadcast(hot) if found <= settings.broadcast_keys else hot, settings)

    def apply(
        self,
        df: DataFrame,
        keys: tuple[str, ...],
        order: tuple[str, ...],
        fn: Callable[[DataFrame, Layout], DataFrame],
        chunk: Column | None = None,
    ) -> DataFrame:
        """Run `fn` with one window per key, and chunk-wise for the hot keys."""
        if self.hot is None:
            return fn(df, Layout(keys, order))
        if chunk is None:
            chunk = F.floor(F.col(order[0]) / F.lit(self.settings.chunk_ms))
        calm = df.join(self.hot, self.key, "left_anti")
        busy = df.join(self.hot, self.key, "left_semi").withColumn("_chunk", chunk)
        done = fn(busy, Layout(keys, order, "_chunk"))
        if "_chunk" in done.columns:
            done = done.drop("_chunk")
        return fn(calm, Layout(keys, order)).unionByName(done)
