"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are read as their letters and digits, lower-cased, with one space between words. An item of m characters may differ
by k = floor(share * m) edits. It is cut into k + 1 pieces of nearly equal size; an occurrence with at most k edits leaves at least one
piece untouched, so every occurrence is found by an exact hit of a piece. All pieces are searched at once by an Aho-Corasick automaton,
and each hit's surroundings are verified with Myers' bit-parallel distance.

The items are collected in groups of at most `group_chars` characters; one pass over the documents is made for each group, so what a
task holds does not grow with the benchmark. Documents are never shuffled.

Defined results: null and empty texts, and texts without letters or digits, match nothing; items without letters or digits match
nothing; equal items are reported each; null item ids are reported as null; repeated documents are searched each.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_arrow, texts
from .graph import checked

GAP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return GAP.sub(" ", text.lower()).strip()


def placed(text: str) -> tuple[str, np.ndarray]:
    """The plain text and, for each of its characters, the place in the text it comes from."""
    low = text.lower()
    if len(low) != len(text):  # a few letters become two when lower-cased; these are read as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out, at = [], []
    end = 0
    for m in GAP.finditer(low):
        if m.start() > end:
            out.append(low[end : m.start()])
            at.append(np.arange(end, m.start()))
        if m.start() > 0 and m.end() < len(low):
            out.append(" ")
            at.append(np.array([m.start()]))
        end = m.end()
    if end < len(low):
        out.append(low[end:])
        at.append(np.arange(end, len(low)))
    return "".join(out), np.concatenate(at) if at else np.zeros(0, np.int64)


def budget(item: str, share: float) -> int:
    return int(len(item) * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their offsets; their sizes differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


class Myers:
    """Least edit distance of a pattern to any part of a text, 64 or 64,000 characters alike: integers serve as bit vectors."""

    def __init__(self, pattern: str):
        self.m, self.masks = len(pattern), defaultdict(int)
        for i, c in enumerate(pattern):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the best end of a part within `most` edits, the first one on ties."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        vp, vn, score, found = full, 0, self.m, None
        get = self.masks.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            x = eq | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hn = vp & d0
            hp = vn | (full & ~(vp | d0))
            score += bool(hp & top) - bool(hn & top)
            hp = (hp << 1) & full
            vp = ((hn << 1) & full) | (full & ~(d0 | hp))
            vn = hp & d0
            if score <= most and (found is None or score < found[0]):
                found = (score, j + 1)
        return found


class Finder:
    """Finds all items of one group in a text."""

    def __init__(self, items: list[tuple[object, str]], share: float):
        import ahocorasick

        self.items = [(i, p, budget(p, share)) for i, t in items if (p := plain(t or ""))]
        self.spelled = [sorted((w for w in p.split(" ") if len(w) > 2), key=len, reverse=True) for _, p, _ in self.items]
        self.forward = [Myers(p) for _, p, _ in self.items]
        self.back = [Myers(p[::-1]) for _, p, _ in self.items]
        self.words = ahocorasick.Automaton()
        where = defaultdict(list)
        for n, (_, p, k) in enumerate(self.items):
            for offset, piece in pieces(p, k):
                where[piece].append((n, offset))
        for piece, places in where.items():
            self.words.add_word(piece, (len(piece), places))
        if where:
            self.words.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, distance): for each item its best occurrence, in offsets of the text as given."""
        if not self.items or not text:
            return []
        hay = plain(text)
        spots = defaultdict(set)
        for end, (size, places) in self.words.iter(hay):
            for n, offset in places:
                spots[n].add(end + 1 - size - offset)
        if not spots:
            return []
        out, at = [], None
        for n, starts in sorted(spots.items()):
            item, pattern, k = self.items[n]
            best = None
            for low, high in _merged(sorted(starts), k):
                a, b = max(0, low - k), min(len(hay), high + len(pattern) + k)
                if b - a < len(pattern) - k or self._missing(n, hay[a:b], k):
                    continue
                hit = self.forward[n].best(hay[a:b], k if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], a, a + hit[1])
                    if not hit[0]:
                        break
            if best is None:
                continue
            distance, a, end = best
            reverse = self.back[n].best(hay[a:end][::-1], distance)
            start = end - reverse[1]
            if at is None:
                spelled, at = placed(text)
                if spelled != hay:  # a letter that changes its length in lower case
                    at = np.minimum(np.arange(len(hay) + 1), len(text) - 1)
            out.append((item, int(at[start]), int(at[end - 1]) + 1, distance))
        return out


    def _missing(self, n: int, window: str, k: int) -> bool:
        """Whether more than k words of the item are nowhere in the window; each of them costs at least one edit of its own."""
        left = k
        for w in self.spelled[n]:
            if w not in window:
                left -= 1
                if left < 0:
                    return True
        return False


def _merged(starts: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Ranges of assumed starts that lie within the error budget of each other, so that no window is verified twice."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > 2 * k + 1:
            yield low, high
            low = s
        high = s
    yield low, high


def groups(items: DataFrame, text: str, group_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct item texts with their digests in groups of about `group_chars` characters, one group at a time."""
    rows = items.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("digest", F.md5("text"))
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // group_chars))
    part = F.pmod(F.xxhash64("digest"), F.lit(parts))
    for i in range(parts):
        yield [(r["digest"], r["text"]) for r in rows.where(part == i).orderBy("digest").collect()]


class Shared:
    """Broadcast items; each worker builds its automaton once and keeps the latest only."""

    def __init__(self, spark, items: list, share: float):
        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast((items, share))

    def finder(self) -> Finder:
        return held(f"items {self.id}", lambda: Finder(*self.held.value))


def matches(df: DataFrame, items: DataFrame, share: float = 0.08, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", group_chars: int = 2_000_000) -> DataFrame:
    """Per document and item found in it: key, item key, start, end, distance (of the best occurrence; offsets in the given text)."""
    rows = texts(df, key, text)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, digest string, start bigint, end bigint, distance int"
    out = None
    for group in groups(items, item_text, group_chars):
        shared = Shared(df.sparkSession, group, share)
        part = in_arrow(rows, functools.partial(_find, shared), schema)
        out = part if out is None else out.union(part)
    # each text is searched once; here the items that have it come back
    names = items.select(F.col(item_key).alias("item"), F.md5(F.col(item_text)).alias("of")).where(F.col("of").isNotNull())
    found = out.join(checked(names), F.col("digest") == F.col("of"))
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "start", "end", "distance")


def _find(shared: Shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = shared.finder()
    for batch in batches:
        keys, found = [], []
        for i, t in enumerate(batch.column(1)):
            for hit in finder.find(t.as_py()):
                keys.append(i)
                found.append(hit)
        yield pa.record_batch(
            [batch.column(0).take(pa.array(keys, pa.int64())), pa.array([h[0] for h in found], pa.string()), *(pa.array([h[j] for h in found], pa.int64()) for j in (1, 2)), pa.array([h[3] for h in found], pa.int32())],
            names=["key", "digest", "start", "end", "distance"],
        )


def clean(df: DataFrame, items: DataFrame, share: float = 0.08, text: str = "text", item_text: str = "text", group_chars: int = 2_000_000) -> DataFrame:
    """The rows of `df`, all columns, in whose text no item is found. Rows with null texts stay."""
    if not df.columns:
        return df
    at = df.columns.index(text)
    for group in groups(items, item_text, group_chars):
        shared = Shared(df.sparkSession, group, share)
        df = in_arrow(df, functools.partial(_keep, shared, at), df.schema)
    return df


def _keep(shared: Shared, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = shared.finder()
    for batch in batches:
        keep = [t.as_py() is None or not finder.find(t.as_py()) for t in batch.column(at)]
        yield batch.filter(pa.array(keep, pa.bool_()))
