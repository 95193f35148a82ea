"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard of a label.

1. Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id, take no part. Bitwise equal
   vectors of a label are one node with a weight.
2. The nodes of a label are one shard, up to `shard` nodes of 64 components; more are dealt to shards by a hash. A task builds the graph of a
   shard: every 16th node is in the upper layer, and each node lies under the upper node nearest to it. Layer by layer, nodes are inserted in
   bulk: the upper layer's links lead to the candidates among which those of the lower layer are chosen.
3. Every shard's nodes query every shard of their label (each pair of shards once). A query enters at all upper nodes that are at most `margin`
   less similar than its nearest one, takes what lies under them, and walks on along the links from the nearest node and from every node found within reach.
   An audit compares the links of some nodes, and of copies planted at the least similarity, with brute force over the shard; while
   its recall is under `recall`, the margin is widened. At twice the greatest distance of two linked vectors a query misses nothing, by the
   triangle inequality.
4. What is found is verified by cosine in double precision. A cell of two shards gives, for each node that has links, their number and the smallest
   node it is connected with; links are counted block by block and never listed. The components of these are joined over all cells.

Defined results: rows that take no part have 0 links and are their own component (null for a null id); repeated rows count as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import checked, components

BLOCK = 1 << 22  # similarities held at once
PAIRS = 1 << 22  # pairs of a query and an upper node held at once


class Graph:
    """A small-world graph over unit vectors in two layers. Nodes are kept in the order of the upper node they lie under."""

    def __init__(self, vectors: np.ndarray, links: int = 12, under: int = 16):
        x = vectors.astype(np.float32)
        n = len(x)
        self.links = links
        upper = np.sort(np.random.default_rng(17).permutation(n)[: -(-n // under)])
        self.top = x[upper]
        above = np.concatenate([(part @ self.top.T).argmax(axis=1) for part in self._parts(x)])
        self.order = np.argsort(above, kind="stable")
        self.x, self.above = x[self.order], above[self.order]
        self.first = np.searchsorted(self.above, np.arange(len(upper) + 1))
        self.near = self._lower(self._upper())

    def _parts(self, x: np.ndarray) -> Iterator[np.ndarray]:
        step = max(1, BLOCK // len(self.top))
        for at in range(0, len(x), step):
            yield x[at : at + step]

    def _upper(self) -> np.ndarray:
        """Links of the upper nodes."""
        k, found, at = min(2 * self.links, len(self.top) - 1), [], 0
        for part in self._parts(self.top):
            s = part @ self.top.T
            s[np.arange(len(part)), at + np.arange(len(part))] = -2
            found.append(_nearest(s, k))
            at += len(part)
        ids, near = (np.concatenate(c) for c in zip(*found, strict=True))
        return self._choose(self.top, ids, near)

    def _lower(self, upper: np.ndarray) -> np.ndarray:
        """Links of all nodes in both directions, -1 where there are fewer. Candidates are the nodes under the same upper node and under those linked to it."""
        n = len(self.x)
        k = min(2 * self.links, n - 1)
        ids, near = np.full((n, k), -1), np.full((n, k), -2, np.float32)
        for h in range(len(self.top)):
            lo, hi = self.first[h], self.first[h + 1]
            others = np.concatenate([np.arange(self.first[g], self.first[g + 1]) for g in (h, *upper[h]) if g >= 0])
            others = others[:: -(-len(others) // 1024)]
            step = max(1, BLOCK // max(1, len(others)))
            for at in range(lo, hi, step):
                mine = np.arange(at, min(hi, at + step))
                s = self.x[mine] @ self.x[others].T
                s[mine[:, None] == others] = -2
                best, value = _nearest(s, min(k, len(others)))
                ids[mine, : best.shape[1]] = np.where(value > -2, others[best], -1)
                near[mine, : best.shape[1]] = value
        chosen = self._choose(self.x, ids, near)
        a = np.repeat(np.arange(n), chosen.shape[1])
        a, b = a[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
        a, b = np.divmod(np.unique(np.r_[a * n + b, b * n + a]), n)
        value = np.concatenate([np.einsum("ij,ij->i", self.x[a[i : i + 65536]], self.x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        order = np.lexsort((-value, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        width = 2 * self.links
        out = np.full((n, width), -1)
        out[a[rank < width], rank[rank < width]] = b[rank < width]
        return out

    def _choose(self, x: np.ndarray, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Up to `links` of each row's candidates (nearest first): those that lie in different directions first, then the nearest others."""
        if ids.shape[1] <= self.links:
            return ids
        out = []
        for at in range(0, len(ids), 4096):
            some, value = ids[at : at + 4096], near[at : at + 4096]
            v = x[some]
            between = v @ v.transpose(0, 2, 1)
            kept = np.zeros(some.shape, bool)
            for k in range(some.shape[1]):
                closest = np.where(kept, between[:, k], -2).max(axis=1)
                kept[:, k] = (closest < value[:, k]) & (some[:, k] >= 0) & (kept.sum(axis=1) < self.links)
            order = np.argsort(~kept, axis=1, kind="stable")[:, : self.links]
            out.append(np.take_along_axis(some, order, axis=1))
        return np.concatenate(out)

    def found(self, queries: np.ndarray, reach: float, margin: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks (queries, nodes, similarities) that hold a similarity of `reach` or more, each pair in one block only; similarities are a matrix, or one
        for each pair where the walk found them. With `own` the queries are the graph's nodes in their order, and each pair comes from its first node."""
        m, tops, at, keys, start = len(queries), len(self.top), 0, [], 0
        for part in self._parts(queries):
            s = part @ self.top.T
            near = s >= (s.max(axis=1) - np.float32(margin))[:, None]
            if own:
                near &= self.above[at : at + len(part), None] <= np.arange(tops)
            row, top = np.divmod(np.flatnonzero(near), tops)
            keys.append(top * m + row + at)
            at += len(part)
            if sum(map(len, keys)) >= PAIRS or at == m:
                yield from self._under(queries, reach, np.sort(np.concatenate(keys)), start, at, own)
                keys, start = [], at

    def _under(self, queries: np.ndarray, reach: float, keys: np.ndarray, start: int, end: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        m, nearest, best = len(queries), np.zeros(end - start, np.int64), np.full(end - start, -2, np.float32)
        cuts = np.searchsorted(keys, np.arange(len(self.top) + 1) * m)
        for h in np.flatnonzero(cuts[1:] > cuts[:-1]):
            lo, hi = self.first[h], self.first[h + 1]
            if lo == hi:
                continue
            step = max(1, BLOCK // (hi - lo))
            for a in range(cuts[h], cuts[h + 1], step):
                rows = keys[a : min(a + step, cuts[h + 1])] - h * m
                s = queries[rows] @ self.x[lo:hi].T
                top = s.max(axis=1)
                better = top > best[rows - start]
                if better.any():
                    nearest[rows[better] - start], best[rows[better] - start] = lo + s[better].argmax(axis=1), top[better]
                if top.max() >= reach:
                    some = top >= reach
                    yield rows[some], np.arange(lo, hi), s[some]
        # the walk: links of the nearest node (and of the query itself), then of each node within reach that was not met before
        rows = np.arange(start, end)
        met = best > -2
        q, at = rows[met], nearest[met]
        if own:
            q, at = np.r_[rows, q], np.r_[rows, at]
        known = np.zeros(0, np.int64)
        while len(q):
            new = []
            for i in range(0, len(q), 16384):
                to = self.near[at[i : i + 16384]]
                part = np.repeat(q[i : i + 16384], to.shape[1])[to.ravel() >= 0]
                to = to.ravel()[to.ravel() >= 0]
                some = np.einsum("ij,ij->i", queries[part], self.x[to]) >= reach
                part, to = part[some], to[some]
                key = self.above[to] * m + part
                seen = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
                new.append((part * len(self.x) + to)[~seen & ((to > part) | (not own))])
            new = np.setdiff1d(np.concatenate(new), known)
            known = np.union1d(known, new)
            q, at = np.divmod(new, len(self.x))
            if len(q):
                yield q, at, np.einsum("ij,ij->i", queries[q], self.x[at])


def _nearest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k greatest of each row, greatest first."""
    ids = np.argpartition(-s, k - 1, axis=1)[:, :k] if 0 < k < s.shape[1] else np.tile(np.arange(s.shape[1])[:k], (len(s), 1))
    value = np.take_along_axis(s, ids, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(value, order, axis=1)


SLACK = 1e-5  # single precision finds candidates, double precision decides


def linked(graph: Graph, base: np.ndarray, queries: np.ndarray, least: float, margin: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Blocks (queries, nodes, links between them); None for the links where the block is a list of linked pairs. `base` is in the order of the graph."""
    for rows, nodes, s in graph.found(queries.astype(np.float32), least - SLACK, margin, own):
        link = s >= least - SLACK
        doubt = np.flatnonzero(link & (s < least + SLACK))
        a, b = (rows[doubt], nodes[doubt]) if s.ndim == 1 else (rows[doubt // len(nodes)], nodes[doubt % len(nodes)])
        for i in range(0, len(a), 65536):
            link.ravel()[doubt[i : i + 65536]] = np.einsum("ij,ij->i", queries[a[i : i + 65536]], base[b[i : i + 65536]]) >= least
        if s.ndim == 1:
            yield rows[link], nodes[link], None
            continue
        if own:
            link &= rows[:, None] < nodes
        yield rows, nodes, link


def audited(graph: Graph, base: np.ndarray, queries: np.ndarray, least: float, recall: float, audit: int, own: bool = False) -> tuple[float, float]:
    """The margin of a recall of `recall`, and the recall: the least of that of the links of some queries and that of copies planted at the least similarity."""
    some = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))
    true = sum(np.count_nonzero(queries[some[i : i + 32]] @ base.T >= least) for i in range(0, len(some), 32)) - own * len(some)
    spots = np.unique(np.linspace(0, len(base) - 1, min(audit, len(base))).astype(int))
    aside = np.random.default_rng(23).normal(size=(len(spots), base.shape[1]))
    aside -= (aside * base[spots]).sum(axis=1, keepdims=True) * base[spots]
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    near = least + (1 - least) * 1e-3
    planted = near * base[spots] + np.sqrt(1 - near * near) * np.where(size > 1e-6, aside / np.maximum(size, 1e-6), 0)
    planted /= np.linalg.norm(planted, axis=1, keepdims=True)
    whole = 2 * np.sqrt(2 - 2 * least) + SLACK
    margin = whole / 2
    while True:
        # what is found has been verified, so its number tells what is missing
        hits = sum(len(a) if link is None else np.count_nonzero(link) for a, _, link in linked(graph, base, queries[some], least, margin)) - own * len(some)
        met = sum(np.count_nonzero(b == spots[a]) if link is None else np.count_nonzero(link & (b == spots[a][:, None])) for a, b, link in linked(graph, base, planted, least, margin))
        reached = min(hits / true if true else 1.0, met / len(spots))
        if reached >= recall or margin >= whole:
            return margin, reached
        margin = min(whole, margin * 1.3)


def cell(ids: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray], same: bool, least: float, recall: float, audit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, smallest id connected within the cell) of the nodes with links of a pair of shards, or of one shard with itself."""
    graph = Graph(vectors[0])
    n, base = len(ids[0]), vectors[0][graph.order]
    queries = base if same else vectors[1]
    every, weight = (ids[0][graph.order], weights[0][graph.order]) if same else (np.r_[ids[0][graph.order], ids[1]], np.r_[weights[0][graph.order], weights[1]])
    shift = 0 if same else n
    margin, _ = audited(graph, base, queries, least, recall, audit, same)
    links, joined, a, b = np.zeros(len(every), np.int64), Joined(len(every)), [], []
    for q, nodes, link in linked(graph, base, queries, least, margin, same):
        q = q + shift
        if link is None:
            np.add.at(links, q, weight[nodes])
            np.add.at(links, nodes, weight[q])
            a.append(q)
            b.append(nodes)
        else:
            count = link.astype(np.float64)
            links[q] += (count @ weight[nodes]).astype(np.int64)
            links[nodes] += (weight[q] @ count).astype(np.int64)
            apart = link & (joined.up[q][:, None] != joined.up[nodes])
            if np.count_nonzero(apart) > 10_000:
                # one link of each row and column joins most of them
                i, j = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                joined.add(np.r_[q[i], q[apart[:, j].argmax(axis=0)]], np.r_[nodes[apart[i].argmax(axis=1)], nodes[j]])
                apart = link & (joined.up[q][:, None] != joined.up[nodes])
            i, j = np.divmod(np.flatnonzero(apart), len(nodes))
            a.append(q[i])
            b.append(nodes[j])
        if sum(map(len, a)) > 200_000:
            joined.add(np.concatenate(a), np.concatenate(b))
            a, b = [], []
    if a:
        joined.add(np.concatenate(a), np.concatenate(b))
    smallest = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(smallest, joined.up, every)
    some = links > 0
    return every[some], links[some], smallest[joined.up][some]


class Joined:
    """Components of links; `up` is a node's representative."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.up[a], self.up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(further := self.up[self.up], self.up):
                self.up = further


def _nodes(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, digest, vector): unit vectors in double precision, null where a row takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, unit = [], []
            lists = batch.column(1)
            flat, ends = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64), lists.offsets.to_pylist()  # null components become NaN
            given = [c.is_valid().to_pylist() for c in batch.columns]
            for i, there in enumerate(zip(*given, strict=True)):
                a = flat[ends[i] : ends[i + 1]] if all(there) else None
                norm = np.linalg.norm(a / np.abs(a).max()) * np.abs(a).max() if a is not None and len(a) and np.isfinite(a).all() and a.any() else 0
                if not norm or not np.isfinite(norm):
                    digest.append(None)
                    unit.append(None)
                    continue
                digest.append(hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest())
                unit.append((a / norm).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())], names=["key", "label", "digest", "vector"])

    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, digest binary, vector binary")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, shard: int = 131072, recall: float = 0.998, audit: int = 512) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (smallest key reachable), kept (key = component_id)."""
    rows = written(_nodes(df, key, vector, label), "vectors")
    nodes = rows.where("digest is not null").groupBy("label", "digest").agg(F.min(F.col("key").cast("bigint")).alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    nodes = written(nodes.withColumn("size", F.length("vector")), "nodes")
    # shards of longer vectors hold fewer nodes
    room = F.count(F.lit(1)) * F.greatest(F.col("size") / 512, F.lit(1.0))
    sizes = written(nodes.groupBy("label", "size").agg(F.ceil(room / shard).cast("int").alias("shards")), "sizes")
    dealt = nodes.join(checked(sizes), ["label", "size"]).withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"))
    # every pair of shards of a label (and vector size) is a cell; a shard's nodes go to each of its cells
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    cells = cells.select("label", "size", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "weight", "digest", "vector", (F.col("shards") == 1).alias("alone"))
    # a cell's work follows its nodes, not its bytes: a number of tasks, so that parts are not merged, and more than cells, so that few meet in one
    count, most = sizes.agg(F.coalesce(F.sum(F.expr("shards * (shards + 1L) div 2")), F.lit(0)), F.coalesce(F.max("shards"), F.lit(0))).first()
    cells = cells.repartition(min(count + 100, 10_000), "label", "size", "x", "y")
    kind = rows.schema["label"].dataType.simpleString()

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        mine, ids, weight = (group.column(c).to_numpy() for c in ("mine", "node", "weight"))
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
        lo, hi = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        a, b = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        # nodes go by their places, which are in the order of their ids
        pair = lambda c: (c, c) if lo == hi else (c[a], c[b])
        at, links, to = cell((a, b), pair(x), pair(weight), lo == hi, least, recall, audit) if len(a) and len(b) else (a[:0],) * 3
        out = {c: group.column(c).take(at) for c in ("label", "node", "digest", "alone")}
        return pa.table(out | {"links": pa.array(links, pa.int64()), "to": pa.array(ids[to], pa.int64()), "to_digest": group.column("digest").take(to)})

    found = cells.groupBy("label", "size", "x", "y").applyInArrow(work, f"label {kind}, node bigint, digest binary, alone boolean, links bigint, to bigint, to_digest binary")
    found = written(found, "found")
    # a label of one shard is done; the others' components are joined over their cells
    known = found.where("alone").select("label", "digest", "links", F.col("to").alias("component"))
    if most > 1:
        rest = found.where("not alone")
        ends = (F.struct("label", F.col(n).alias("node"), F.col(d).alias("digest")).alias(c) for n, d, c in (("node", "digest", "a"), ("to", "to_digest", "b")))
        joined = components(rest.select(*ends)).select("node.label", "node.digest", F.col("component.node").alias("component"))
        known = known.union(rest.groupBy("label", "digest").agg(F.sum("links").alias("links")).join(checked(joined), ["label", "digest"]))
    known = nodes.select("label", "digest", "node", "weight").join(checked(known), ["label", "digest"], "left")
    known = known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("key", "label", "digest").join(checked(known), ["label", "digest"], "left")
    component = F.coalesce("component_id", F.col("key").cast("bigint"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept"))
