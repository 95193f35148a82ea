"""Exact Jaccard join on word shingles by T-occurrence search (DivideSkip).

1. Sets. A text gives the set of hashes (64 bits) of its shingles. Documents with equal sets (128-bit digest) are one class,
   represented by its smallest key.
2. Blocks. Sets of linked documents differ in at most H elements, H following from the sizes. The hash range is cut into H + 1 parts, so
   linked sets agree in a whole part, and with some spare parts in more than `spare` of them. Each set sends one digest for each part
   that holds elements. If linked sets agree in empty parts only, both have more than `spare` empty ones; such sets send the first
   n - ceil(t n) + 1 hashes as well, of which linked sets share one. Documents that share a digest are tied to the smallest of
   them (a star, never all pairs), and the components of the ties are blocks that no link leaves. A passage that many documents
   share makes no tie in a part, which must agree as a whole; few sets send first hashes.
3. Sieve. Ties chain families of loosely similar documents (a shared licence line is enough), so blocks are cut once more before whole sets are
   sent anywhere. A set's parity signature has a bit for each of B buckets, B two to four times the set's size: whether it holds an odd number of
   elements there. Signatures of two sets differ in at most as many bits as the sets in elements, so pairs that differ in more bits than a
   link allows in elements are no links; the components of all other pairs are the blocks that are searched. Only documents of equal or
   neighbouring size levels are compared, in cells of two chunks.
4. Search. Inside a block every document queries an inverted index for those with at least T = ceil(t n) common shingles: the long
   lists are set aside, the short ones are merged by a heap, and documents that occur often enough are probed for in the long lists by
   binary search. The count is then the size of the intersection, and the link is decided exactly. Documents already connected are
   passed over. A block of many documents is dealt into chunks, and every pair of chunks is a cell of bounded size.
5. Components of the links found.

Defined results: null and empty texts have an empty set and link with nothing; texts of fewer words than a shingle have the whole
sequence as one; null keys link with nothing and have a null component; rows with equal keys belong together.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, held, in_arrow, map_rows, texts, written
from .graph import checked, components

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MU = 0.0085  # of DivideSkip: weight of a probe against a merge step


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Words: A-Z lower-cased, split at ASCII white space."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    x = h[:n].copy()
    for i in range(1, size):
        x = _mixed(x) + h[i : i + n]
    return np.unique(_mixed(x))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * K1
    x = (x ^ (x >> np.uint64(29))) * K2
    return x ^ (x >> np.uint64(32))


class Levels:
    """Size levels of ratio 1/t. Linked documents are of the same level or of neighbouring ones."""

    def __init__(self, percent: int):
        self.t, self.starts = percent, [1]
        self.dealt: dict[int, tuple[int, int]] = {}

    def top(self, level: int) -> int:
        while len(self.starts) <= level + 1:
            self.starts.append(self.starts[-1] * 100 // self.t + 1)
        return self.starts[level + 1] - 1

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.top(len(self.starts) - 1)
        return bisect.bisect_right(self.starts, n) - 1

    def parts(self, level: int) -> int:
        """One more than the most elements in which linked sets of this level and the next can differ."""
        low = self.top(level)
        high = min(self.top(level + 1), low * 100 // self.t)
        return (low + high) * (100 - self.t) // (100 + self.t) + 1

    def spare(self, level: int) -> tuple[int, int]:
        """The number of parts with spare ones, and how many those are: linked sets agree in more than that many parts. As many as
        leave about 1 % of the smallest sets with more empty parts, at most an eighth. This decides a route, not a result."""
        if level not in self.dealt:
            n, m = (self.top(level - 1) + 1 if level else 1), self.parts(level)
            for spare in range(m // 8 + 1):
                empty = (m + spare) * math.exp(-n / (m + spare))
                if 1 - sum(math.exp(k * math.log(empty) - empty - math.lgamma(k + 1)) for k in range(spare + 1)) < 0.01:
                    break
            self.dealt[level] = m + spare, spare
        return self.dealt[level]


def first_hashes(s: np.ndarray, level: int, percent: int) -> np.ndarray:
    """Digests of the n - ceil(t n) + 1 first elements: sets that have at least t n and t n' elements in common share one."""
    first = s[: len(s) - -(-percent * len(s) // 100) + 1]
    return _mixed(_mixed(first + K2) + np.uint64(level + 1))


def part_digests(s: np.ndarray, level: int, m: int) -> np.ndarray:
    """A digest for each of the m parts of the hash range that holds elements."""
    part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    total = np.add.reduceat(_mixed(s), starts)
    return _mixed(total ^ _mixed(part[starts] * K2 + np.uint64(level + 1)))


def digests(s: np.ndarray, levels: Levels) -> np.ndarray:
    """Digests of the set's own level and of the one below, with which it meets smaller sets."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    level, out = levels.of(n), []
    for at in (level, level - 1):
        if at < 0 or levels.parts(at) == 1:
            continue
        m, spare = levels.spare(at)
        out.append(part_digests(s, at, m))
        if m - len(out[-1]) > spare:
            out.append(first_hashes(s, at, levels.t))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n, high, low): set size and digest per row."""
    import xxhash

    def each(keys: list, batch: list[str]) -> dict:
        held("nothing")
        out: dict = {"key": keys, "n": [], "high": [], "low": []}
        for t in batch:
            s = shingles(t, size)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            out["n"].append(len(s))
            out["high"].append((d >> 64) - (1 << 63))
            out["low"].append((d & (2**64 - 1)) - (1 << 63))
        return out

    rows = texts(df, key, text)
    return map_rows(rows, f"key {rows.schema['key'].dataType.simpleString()}, n bigint, high bigint, low bigint", each)


def ties(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b): documents that agree in a part, tied to the smallest key of those that do.

    A part of the documents is read first for digests that very many share (at most 20,000 are taken). Of these a task sends on only
    one row each and ties its other documents to that row's, so no digest gathers many rows; which digests go this way has no effect
    on the components."""
    kind = df.schema[key].dataType.simpleString()

    def sender(common):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held("nothing")
            levels, met, anchors = Levels(percent), set(), {}
            hot = common.value if common else np.zeros(0, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    keys = some.column(0).to_pylist()
                    found, rows, to = [], [], []
                    for i, t in enumerate(some.column(1).to_pylist()):
                        s = shingles(t, size)
                        mark = hash(s.tobytes())
                        if mark in met:  # an equal set of this task has sent its digests
                            continue
                        if len(met) < 1_000_000:
                            met.add(mark)
                        own = digests(s, levels).view(np.int64)
                        anchor = None
                        if len(hot):
                            place = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                            shared = hot[place] == own
                            if shared.any():
                                first = [anchors.setdefault(d, keys[i]) for d in own[shared].tolist()]
                                send = ~shared
                                send[shared] = [h == keys[i] for h in first]
                                own = own[send]
                                for h in {h for h in first if h != keys[i]}:
                                    found.append(np.zeros(1, np.int64))
                                    rows.append(i)
                                    to.append(h)
                        found.append(own)
                        rows.append(i)
                        to.append(anchor)
                    lengths = np.fromiter(map(len, found), np.int64, len(found))
                    spread = pa.array(np.repeat(np.arange(len(rows)), lengths))
                    yield pa.record_batch(
                        [pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), some.column(0).take(pa.array(rows, pa.int64()).take(spread)), pa.array(to, some.column(0).type).take(spread)],
                        names=["digest", "key", "anchor"],
                    )

        return run

    schema = f"digest bigint, key {kind}, anchor {kind}"
    rows = texts(df.where(F.col(key).isNotNull()), key, text)
    sampled = rows.where(F.pmod(F.xxhash64("key"), F.lit(64)) == 0)
    seen = in_arrow(sampled, sender(None), schema).groupBy("digest").count()
    common = sorted(r["digest"] for r in seen.where("count >= 8").orderBy(F.desc("count"), "digest").limit(20_000).collect())
    shared = df.sparkSession.sparkContext.broadcast(np.array(common, np.int64))
    sent = in_arrow(rows, sender(shared), schema)
    # rows that are tied already go by their own key, so they meet in no group
    group = F.when(F.col("anchor").isNull(), F.col("digest")).otherwise(F.xxhash64("key", "anchor"))
    least = F.min(F.when(F.col("anchor").isNull(), F.col("key"))).over(Window.partitionBy("group"))
    tied = sent.withColumn("group", group).select(F.col("key").alias("a"), F.coalesce("anchor", least).alias("b"))
    return tied.where("a <> b").distinct()


def signature(s: np.ndarray, bits: int) -> bytes:
    """Parity of the number of elements in each of `bits` buckets (a power of two, 64 at least)."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def width(level: int, levels: Levels) -> int:
    """Bits of a signature: two to four times the largest set of the level, within bounds of memory (any width is right)."""
    return max(256, min(65_536, 1 << (2 * levels.top(level) - 1).bit_length()))


def cell_candidates(sizes: np.ndarray, signs: np.ndarray, base: np.ndarray, queries: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (query, base), by place, that connect what the signatures (64-bit words, a row for each set) do not keep apart."""
    base = base[np.argsort(sizes[base], kind="stable")]
    near, known = signs[base], sizes[base]
    group = np.arange(len(sizes))
    for q in queries.tolist():
        n = sizes[q]
        # from t n to n / t elements
        low, high = np.searchsorted(known, -(-percent * n // 100)), np.searchsorted(known, n * 100 // percent, "right")
        at = np.arange(low, high)[group[base[low:high]] != group[q]]
        if not len(at):
            continue
        both = n + known[at]
        most = both - 2 * -(-percent * both // (100 + percent))
        apart = np.bitwise_count(near[at] ^ signs[q]).sum(1, dtype=np.int64)
        for other in base[at[apart <= most]].tolist():
            if group[other] != group[q]:
                group[group == group[other]] = group[q]
                yield q, other


def candidates(blocks: DataFrame, df: DataFrame, key: str, text: str, size: int, percent: int, most: int) -> DataFrame:
    """(a, b): pairs inside the blocks (node, component) that connect all documents which may be linked, judged by their signatures."""
    kind = df.schema[key].dataType.simpleString()
    levels = Levels(percent)

    def build(keys: list, batch: list[str]) -> dict:
        out: dict = {"key": [], "n": [], "level": [], "home": [], "sign": []}
        for k, t in zip(keys, batch, strict=True):
            s = shingles(t, size)
            own = levels.of(len(s))
            for level in (own, own - 1)[: 2 if own else 1]:  # at the level below a set meets the smaller ones
                for name, value in zip(out, (k, len(s), level, level == own, signature(s, width(level, levels))), strict=True):
                    out[name].append(value)
        return out

    place = checked(blocks.select(F.col("node").alias("key"), "component"))
    wanted = texts(df, key, text).join(place.select("key"), "key", "left_semi")
    signs = map_rows(wanted, f"key {kind}, n bigint, level int, home boolean, sign binary", build, 128)
    stored = written(signs.join(place, "key"), "signs")
    # a chunk holds some `most` sets, of the level or of the one above
    counts = stored.groupBy("component", "level").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    chunks = lambda c: F.ceil(F.col(c) / most).cast("int")
    counts = counts.where("homes > 0 and homes + guests > 1").select("component", "level", chunks("homes").alias("own"), chunks("guests").alias("above"))
    dealt = stored.join(checked(counts), ["component", "level"])
    nth = lambda c: F.pmod(F.xxhash64("key"), F.greatest(F.col(c), F.lit(1))).cast("int")
    dealt = dealt.withColumn("mine", F.when(F.col("home"), nth("own")).otherwise(F.col("own") + nth("above")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("own") + F.col("above")).otherwise(F.col("own")) - 1)).alias("other")
    cells = dealt.select("key", "n", "sign", "component", "level", "mine", other)
    cells = cells.select("key", "n", "sign", "component", "level", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    cell = ["component", "level", "x", "y"]
    placed = cells.repartition(*cell).sortWithinPartitions(*cell, "mine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nothing")

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True)

        found: list[tuple] = []
        for (_, _, x, y), group in groupby(rows(), key=lambda r: (r[3], r[4], r[6], r[7])):
            members = list(group)
            first = np.array([r[5] for r in members]) == x
            if len(members) < 2 or (x != y and (first.all() or not first.any())):
                continue
            signs = np.frombuffer(b"".join(r[2] for r in members), np.uint64).reshape(len(members), -1)
            pairs = cell_candidates(np.array([r[1] for r in members]), signs, np.flatnonzero(first), np.flatnonzero(first if x == y else ~first), percent)
            found += [(members[q][0], members[b][0]) for q, b in pairs]
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    type_ = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    batch_of = lambda pairs: pa.record_batch([pa.array([p[i] for p in pairs], type_) for i in (0, 1)], names=["a", "b"])
    found = written(in_arrow(placed, run, f"a {kind}, b {kind}"), "candidates")
    drop(stored)
    return found


class Index:
    """Inverted lists over some documents, for T-occurrence search."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = [len(s) for s in members]
        self.lists: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(members):
            for token in s.tolist():
                self.lists[token].append(i)

    def search(self, query: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Members whose Jaccard similarity with the query is at least percent / 100, but for those that `skip` names."""
        n = len(query)
        need = -(-percent * n // 100)
        lists = sorted((x for t in query.tolist() if (x := self.lists.get(t))), key=len)
        if len(lists) < need:
            return
        # DivideSkip: the longest lists are only probed
        aside = min(need - 1, int(need / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        for i, group in groupby(heapq.merge(*short)):
            have = sum(1 for _ in group)
            if have + aside < need or skip(i):
                continue
            size = self.sizes[i]
            least = -(-percent * (n + size) // (100 + percent))
            if size * percent > n * 100 or n * percent > size * 100:
                continue
            left = aside
            for x in long:
                if have + left < least:
                    break
                at = bisect.bisect_left(x, i)
                have += at < len(x) and x[at] == i
                left -= 1
            if have + left >= least and 100 * have >= percent * (n + size - have):
                yield i


def cell_links(keys: list, members: list[np.ndarray], own: list[int], percent: int, two: bool) -> Iterator[tuple]:
    """Links that connect the members of a cell; with `two`, between its two chunks only."""
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    base = [i for i, c in enumerate(own) if c == own[0]] if two else list(range(len(keys)))
    index = Index([members[i] for i in base])
    queries = [i for i, c in enumerate(own) if c != own[0]] if two else base
    for q in queries:
        mine = root(q)
        for j in index.search(members[q], percent, lambda i, r=mine: root(base[i]) == r):
            other = root(base[j])
            if other != root(q):
                parent[other] = root(q)
                yield keys[q], keys[base[j]]


def links(blocks: DataFrame, df: DataFrame, key: str, text: str, size: int, percent: int, most: int) -> DataFrame:
    """(a, b): links that connect the documents of each block (node, component)."""
    kind = df.schema[key].dataType.simpleString()
    sizes = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    dealt = blocks.join(sizes, "component").withColumn("chunks", F.ceil(F.col("size") / most).cast("int"))
    dealt = written(dealt.select(F.col("node").alias("key"), "component", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("mine")), "dealt")

    def build(keys: list, batch: list[str]) -> dict:
        return {"key": keys, "elements": [shingles(t, size).tobytes() for t in batch]}

    wanted = texts(df, key, text).join(checked(dealt.select("key")), "key", "left_semi")
    elements = map_rows(wanted, f"key {kind}, elements binary", build, 128)
    stored = written(elements.join(checked(dealt), "key"), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    cells = stored.select("key", "elements", "component", "mine", other)
    cells = cells.select("key", "elements", "component", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    cell = ["component", "x", "y"]
    # a cell has at most two chunks; cells are streamed one after the other
    placed = cells.repartition(*cell).sortWithinPartitions(*cell, "mine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nothing")

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True)

        for (_, x, y), group in groupby(rows(), key=lambda r: (r[2], r[4], r[5])):
            members = list(group)
            if len(members) < 2:
                continue
            keys, own = [r[0] for r in members], [r[3] for r in members]
            found = list(cell_links(keys, [np.frombuffer(r[1], np.uint64) for r in members], own, percent, x != y))
            if found:
                yield pa.record_batch([pa.array([f[i] for f in found], type_) for i in (0, 1)], names=["a", "b"])

    type_ = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = written(in_arrow(placed, run, f"a {kind}, b {kind}"), "found")
    drop(dealt, stored)
    return found


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, most: int = 1000) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable over links of at least percent / 100 similarity)."""
    rows = written(sets(df, key, text, size), "sets")
    usable = rows.where("key is not null and n > 0")
    equal = written(usable.groupBy("high", "low").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    keyed = usable.join(equal, ["high", "low"]).select("key", "rep", "copies")
    reps = written(keyed.where("copies > 1 or key <> rep").select("key", "rep").distinct(), "copies")
    raw = written(ties(df, key, text, size, percent), "ties")
    known = checked(reps)
    tied = raw
    for side in ("a", "b"):  # ties between classes of equal sets
        tied = tied.join(known.select(F.col("key").alias(side), F.col("rep").alias(f"{side}_rep")), side, "left")
        tied = tied.withColumn(side, F.coalesce(f"{side}_rep", side)).drop(f"{side}_rep")
    chained = components(tied.select("a", "b"))
    drop(raw, equal)
    near = candidates(chained, df, key, text, size, percent, most)
    blocks = components(near)
    drop(near)
    found = links(blocks, df, key, text, size, percent, most)
    # keys of equal rows, and copies of a class, hang on its smallest key
    joined = components(found.select("a", "b").union(reps.select(F.col("key").alias("a"), F.col("rep").alias("b"))))
    out = rows.join(checked(joined.select(F.col("node").alias("key"), "component")), "key", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, most: int = 1000) -> DataFrame:
    """The rows of `df`, all columns, but one document alone of each group: the one with the smallest key. Rows with equal keys are one
    document, of which one row stays. Null keys are linked with nothing and stay."""
    found = written(classes(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", size, percent, most), "groups")
    gone = found.where("key <> component_id").select("key").distinct()
    left = df.join(checked(gone.withColumnRenamed("key", "__gone")), F.col(key) == F.col("__gone"), "left_anti")
    again = written(found.groupBy("key").count().where("key is not null and count > 1").select(F.col("key").alias("__again")), "again")
    if not again.take(1):
        return left
    plain = left.join(checked(again), F.col(key) == F.col("__again"), "left_anti")
    several = left.join(checked(again), F.col(key) == F.col("__again"), "left_semi")
    first = several.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*df.columns)))).where("__n = 1")
    return plain.unionByName(first.drop("__n"))
