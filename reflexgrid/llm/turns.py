"""Repair of the order of roles in conversations, by block tables (the method of the Four Russians).

A conversation is repaired when the initials of its roles read `(s?(ua)+)?`. Edits: keep a row (0), give it the role user or assistant
(3), delete it (4; the only edit of blank and repeated rows), insert an empty row of the role user or assistant (3); a truncated row that
is not deleted costs 3 more. The cheapest edits are written as their initials in order (K, R, D, I); of equally cheap ones the
least in ASCII wins.

How it runs.

1. The cost to go from a row is a vector over the four states of the pattern. Its entries differ by at most a constant, so with the least
   one taken off only a few dozen vectors exist (`TABLES` finds them all). For every block of `BLOCK` symbols and every such
   vector the vector before the block and the cost are precomputed; a conversation is worked through block by block by lookup, from its end.
2. For the trace only the vectors at block ends are kept; each block is expanded backward to its inner vectors when the trace enters it. The trace
   runs from the front and takes the first letter in ASCII order that loses nothing, so ties are exact.
3. Rows are sorted by (conversation, turn, role, digest) over the cluster and cut into chunks of at most `CHUNK` rows, so no task holds
   a conversation. A chunk is a finite map: from the vector behind it to the one before it, and, once that is known, from the state
   at its front to the one at its end. Maps of one conversation are composed in a tree of `FAN` chunks a node (`scan`).
   Texts take part twice: as digests in the sort, and in `repaired`, which streams the kept rows in order.

Defined results: null roles and texts count as one space; null turns come first and count in no gap; rows of one conversation and turn are
ordered by role, then by a digest of role and text; equal rows stand side by side, the later ones are repeats. Rows of a null
conversation id form one conversation. Conversations without rows have zeros and an empty audit. Roles of other initials than s, u, a
can be given a role or deleted. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KEEP, RENAME, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
BLOCK = 4
CHUNK = 4096
FAN = 512

# States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 may end a conversation.
FREE, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {("s", FREE): AFTER_S, ("u", FREE): AFTER_U, ("u", AFTER_S): AFTER_U, ("a", AFTER_U): AFTER_A, ("u", AFTER_A): AFTER_U}
ADDED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after a row that is inserted or given the role the pattern wants
ROLE_OF = ("", "", "user", "assistant")  # by the state after it

# Symbols of rows: initial (s, u, a, other), + 4 if truncated; MUST_GO; and PAD, which fills the last block and changes nothing.
MUST_GO, PAD, SYMBOLS = 8, 9, 10
KEPT = [[NEXT.get((c, x), -1) for x in range(4)] for c in "sua?"]  # the state after keeping a row, -1 where it does not fit


def closed(g: list[int]) -> list[int]:
    """Costs to go when rows may be inserted first."""
    u, a = g[AFTER_U], g[AFTER_A]
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return [min(g[FREE], INSERT + u), min(g[AFTER_S], INSERT + u), u, a]


def before(symbol: int, f: list[int]) -> list[int]:
    """Costs to go before a row, from those behind it."""
    if symbol == PAD:
        return list(f)
    g = [DELETE + v for v in f]
    if symbol != MUST_GO:
        cut, kept = CUT * (symbol // 4), KEPT[symbol % 4]
        for x in range(4):
            g[x] = min(g[x], RENAME + cut + f[ADDED[x]])
            if kept[x] >= 0:
                g[x] = min(g[x], KEEP + cut + f[kept[x]])
    return closed(g)


END = closed([0, 10**6, 10**6, 0])


class Tables:
    """All normalised cost vectors, and the transitions of single symbols and of blocks: `step[v][s]` and `block[v][code]` are the
    vector before, `step_cost` and `block_cost` what was taken off."""

    def __init__(self, length: int = BLOCK):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.end, self.end_cost = self._known(END)
        step, cost = [], []
        for v in self.vectors:  # grows while it is walked through
            reached = [self._known(before(s, list(v))) for s in range(SYMBOLS)]
            step.append([n for n, _ in reached])
            cost.append([c for _, c in reached])
        self.step, self.step_cost = step, cost
        one, paid = np.array(step, np.int32), np.array(cost, np.int32)
        block, total = np.arange(len(step), dtype=np.int32)[:, None], np.zeros((len(step), 1), np.int32)
        for _ in range(length):  # a symbol in front of the blocks so far; the first symbol is the highest digit
            total = (total[:, None, :] + np.swapaxes(paid[block], 1, 2)).reshape(len(step), -1)
            block = np.swapaxes(one[block], 1, 2).reshape(len(step), -1)
        self.length, self.block_np, self.cost_np = length, block, total
        self.block, self.block_cost = block.tolist(), total.tolist()

    def _known(self, f: list[int]) -> tuple[int, int]:
        low = min(f)
        key = tuple(v - low for v in f)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], low

    def codes(self, symbols: bytes) -> list[int]:
        """Block codes of a chunk; the last block is filled up."""
        padded = np.frombuffer(symbols + bytes([PAD]) * (-len(symbols) % self.length), np.uint8).reshape(-1, self.length)
        return (padded @ (SYMBOLS ** np.arange(self.length - 1, -1, -1))).tolist()

    def ends(self, symbols: bytes, last: int) -> tuple[list[int], int]:
        """The vector behind every block and before the first one, given the one behind the chunk; and the cost taken off."""
        at, cost, out = last, 0, [last]
        for code in reversed(self.codes(symbols)):
            cost += self.block_cost[at][code]
            at = self.block[at][code]
            out.append(at)
        return out[::-1], cost

    def through(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The chunk as a map: for every vector behind it the one before it, and the cost taken off."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for code in reversed(self.codes(symbols)):
            cost += self.cost_np[at, code]
            at = self.block_np[at, code]
        return at, cost

    def trace(self, symbols: bytes, last: int, state: int) -> tuple[list[str], list[int], int]:
        """For every row its letters (inserted rows before it, then its own), the state it is entered in, and the state at the end."""
        ends, _ = self.ends(symbols, last)
        letters, states = [], []
        for b in range(len(ends) - 1):
            part = symbols[b * self.length : (b + 1) * self.length]
            inner = [ends[b + 1]]
            for s in reversed(part):
                inner.append(self.step[inner[-1]][s])
            for i, s in enumerate(part):
                f, behind = self.vectors[inner[len(part) - i]], self.vectors[inner[len(part) - i - 1]]
                lift = self.step_cost[inner[len(part) - i - 1]][s]
                mine = ""
                while True:
                    if DELETE + behind[state] == f[state] + lift:
                        mine += "D"
                        break
                    if INSERT + f[ADDED[state]] == f[state]:
                        mine, state = mine + "I", ADDED[state]
                        continue
                    kept = KEPT[s % 4][state]
                    if kept >= 0 and KEEP + CUT * (s // 4) + behind[kept] == f[state] + lift:
                        mine, state = mine + "K", kept
                    else:
                        mine, state = mine + "R", ADDED[state]
                    break
                letters.append(mine)
                states.append(state)
        return letters, states, state


@cache
def tables() -> Tables:
    return Tables()


def tail(state: int) -> str:
    """Letters behind the last row."""
    out, f = "", END
    while f[state]:
        out, state = out + "I", ADDED[state]
    return out


# ---- rows


def damaged(turns: DataFrame) -> DataFrame:
    """The damage that query op11 prescribes: by crc32 of `conv_id:turn` modulo 20 rows are dropped (0), emptied (1), lose their sentence ends (2),
    are repeated (3) or become the user's (4)."""
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), part.alias("part"))
        .where("part <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        )
        .drop("again")
    )


def _keyed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with a text key of the conversation, a digest of role and text, and the faults that a row shows by itself."""
    r, t = F.coalesce(role, F.lit(" ")), F.coalesce(text, F.lit(" "))
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.select(
        "conv",
        "turn",
        "role",
        "text",
        F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("digest"),
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )


def _turn_key(turn: str = "turn") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(turn).cast("string")), F.lit(""))


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """One row per run of at most `chunk` distinct rows of a conversation, in order (part, k)."""
    single = rows.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("n"), F.lit(False).alias("first"))
    # the first of all rows of equal role and text, found without gathering them: its key is marked and merged with the counts
    first = single.groupBy("conv", "role", "digest", "blank", "cut").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("least"))
    marks = first.select("conv", "least.turn", "role", "digest", "blank", "cut", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("first"))
    merged = single.unionByName(marks).groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    keys = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    ordered = merged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = rows.schema["turn"].dataType.simpleString()
    schema = f"conv string, part int, k bigint, symbols binary, keys array<struct<turn:{kind},digest:binary,role:string,n:bigint>>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, front string, back string"
    return written(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(partial(_pack, most=chunk), schema), "chunks")


PAIRS = {"su", "ua", "au"}


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    conv, part, run, k = None, 0, [], 0
    size = 0
    for batch in batches:
        types = batch.schema.field("turn").type
        out = []
        for row in batch.to_pylist():
            if run and (row["conv"] != conv or len(run) == most):
                out.append(_packed(conv, part, k, run))
                size += len(run)
                run, k = [], k + 1
                if size > 1 << 16:
                    yield _batch(out, types)
                    out, size = [], 0
            conv, part = row["conv"], row["part"]
            run.append(row)
        if out:
            yield _batch(out, types)
    if run:
        yield _batch([_packed(conv, part, k, run)], types)


def _packed(conv: str, part: int, k: int, run: list[dict]) -> dict:
    symbols = bytearray()
    blank = duplicate = truncated = illegal = 0
    last = None
    for row in run:
        c, n = row["role"][:1], row["n"]
        gone = row["blank"] or not row["first"]
        symbols.append(MUST_GO if gone else ("sua".find(c) % 4 if c else 3) + 4 * row["cut"])
        if row["blank"]:
            blank += n
        elif not row["first"]:
            duplicate += n
        else:
            duplicate += n - 1
            truncated += row["cut"]
        illegal += (last is not None and last + c not in PAIRS) + (n - 1) * (c + c not in PAIRS)
        last = c
    keys = [{"turn": r["turn"], "digest": r["digest"], "role": r["role"], "n": r["n"]} for r in run]
    return {"conv": conv, "part": part, "k": k, "symbols": bytes(symbols), "keys": keys, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "front": run[0]["role"][:1], "back": last}


def _batch(rows: list[dict], turn: pa.DataType) -> pa.RecordBatch:
    keys = pa.list_(pa.struct([("turn", turn), ("digest", pa.binary()), ("role", pa.string()), ("n", pa.int64())]))
    kinds = [("conv", pa.string()), ("part", pa.int32()), ("k", pa.int64()), ("symbols", pa.binary()), ("keys", keys)]
    kinds += [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")] + [("front", pa.string()), ("back", pa.string())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


# ---- finite maps along a conversation


def scan(maps: DataFrame, start: int, name: str, fan: int = FAN) -> DataFrame:
    """`maps` holds (conv, at, go): `go[x]` is where the map takes x; maps of a conversation apply by ascending `at`, from `start`.
    Returns (conv, at, given): what each map is applied to. Maps are composed in a tree of `fan` children a node, so no task sees more
    than `fan` maps of a conversation at once."""
    levels = [maps.select("conv", F.col("at").alias("up"), (F.row_number().over(Window.partitionBy("conv").orderBy("at")) - 1).alias("i"), "go")]
    levels[0] = written(levels[0], name)
    while levels[-1].where("i > 0").take(1):
        grouped = levels[-1].groupBy("conv", F.floor(F.col("i") / fan).alias("g"))
        composed = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "go"))), lambda m: m["go"]).alias("all"))
        joined = F.aggregate(F.slice("all", 2, fan), F.element_at("all", 1), lambda so_far, m: F.transform(so_far, lambda x: F.element_at(m, x + 1)))
        levels.append(written(composed.select("conv", F.col("g").alias("i"), joined.alias("go")), name))
    given = levels[-1].select("conv", "i", F.lit(start).alias("given"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("g", F.floor(F.col("i") / fan)).groupBy("conv", "g").agg(F.array_sort(F.collect_list(F.struct("i", "go"))).alias("all"))
        down = child.join(given.withColumnRenamed("i", "g"), ["conv", "g"])
        steps = F.aggregate("all", F.array("given"), lambda done, m: F.concat(done, F.array(F.element_at(m["go"], F.element_at(done, -1) + 1))))
        given = down.select("conv", F.posexplode(F.arrays_zip(F.col("all.i").alias("i"), F.slice(steps, 1, F.size("all")).alias("given")))).select("conv", "col.i", "col.given")
    return levels[0].select("conv", "i", "up").join(given, ["conv", "i"]).select("conv", F.col("up").alias("at"), "given")


def _mapped(chunks: DataFrame, each, schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield each(batch.slice(at, 64))

    return chunks.select(*columns).mapInArrow(run, schema)


def edits(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv, part, k, i, turn, digest, role, letters, renamed, added, cost): the edits of every distinct row, in order; the letters of its
    repeats and, on the last row, of rows inserted behind it included. `renamed` is the role of a row that stays; `added` lists the
    roles of rows inserted before it and, after a semicolon, behind it."""
    backward = _mapped(chunks.where("many"), _vector_maps, "conv string, part int, k bigint, go array<int>", ["conv", "part", "k", "symbols"])
    order = F.struct("part", "k")
    several = scan(backward.select("conv", F.struct(-F.col("part"), -F.col("k")).alias("at"), "go"), tables().end, "vector-maps", fan)
    behind = several.select("conv", (-F.col("at")["col1"]).alias("part"), (-F.col("at")["col2"]).alias("k"), F.col("given").alias("behind"))
    known = written(chunks.where("many").join(behind, ["conv", "part", "k"]), "behind")
    forward = _mapped(known, _state_maps, "conv string, part int, k bigint, go array<int>", ["conv", "part", "k", "symbols", "behind"])
    states = scan(forward.select("conv", order.alias("at"), "go"), FREE, "state-maps", fan).select("conv", "at.part", "at.k", F.col("given").alias("entered"))
    alone = chunks.where("not many").select("*", F.lit(tables().end).alias("behind"), F.lit(FREE).alias("entered"))
    every = alone.unionByName(known.join(states, ["conv", "part", "k"]))
    kind = chunks.schema["keys"].dataType.elementType["turn"].dataType.simpleString()
    schema = f"conv string, part int, k bigint, i int, turn {kind}, digest binary, role string, letters string, renamed string, added string, cost bigint"
    return _mapped(every, _traced, schema, ["conv", "part", "k", "symbols", "keys", "behind", "entered", "last"])


def _vector_maps(batch: pa.RecordBatch) -> pa.RecordBatch:
    go = [tables().through(s)[0].tolist() for s in batch.column("symbols").to_pylist()]
    return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(go, pa.list_(pa.int32()))], names=["conv", "part", "k", "go"])


def _state_maps(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True)
    go = [[tables().trace(s, b, x)[2] for x in range(4)] for s, b in rows]
    return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(go, pa.list_(pa.int32()))], names=["conv", "part", "k", "go"])


def _traced(batch: pa.RecordBatch) -> pa.RecordBatch:
    kind = batch.schema.field("keys").type.value_type.field("turn").type
    out: dict[str, list] = {c: [] for c in ("conv", "part", "k", "i", "turn", "digest", "role", "letters", "renamed", "added", "cost")}
    for row in batch.to_pylist():
        letters, states, _ = tables().trace(row["symbols"], row["behind"], row["entered"])
        state = row["entered"]
        for i, (key, mine, left) in enumerate(zip(row["keys"], letters, states, strict=True)):
            own = mine[-1]
            added = []
            for _ in mine[:-1]:
                state = ADDED[state]
                added.append(ROLE_OF[state])
            state = left
            text = mine + "D" * (key["n"] - 1)
            behind = ""
            if row["last"] and i == len(letters) - 1:
                behind = tail(state)
                text += behind
            back = []
            for _ in behind:
                state = ADDED[state]
                back.append(ROLE_OF[state])
            out["conv"].append(row["conv"])
            out["part"].append(row["part"])
            out["k"].append(row["k"])
            out["i"].append(i)
            out["turn"].append(key["turn"])
            out["digest"].append(key["digest"])
            out["role"].append(key["role"])
            out["letters"].append(text)
            out["renamed"].append(ROLE_OF[left] if own == "R" else key["role"] if own == "K" else None)
            out["added"].append(",".join(added) + ";" + ",".join(back))
            cut = CUT * (row["symbols"][i] // 4) if own in "KR" else 0
            out["cost"].append(cut + RENAME * text.count("R") + DELETE * text.count("D") + INSERT * text.count("I"))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), kind, pa.binary()] + [pa.string()] * 4 + [pa.int64()]
    return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


# ---- results


def plan(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, chunks, edits) of a table of turns; the edits are written."""
    rows = _keyed(turns, conv, turn, role, text)
    chunks = _chunks(rows.drop("text"), chunk)
    near = Window.partitionBy("conv").orderBy("part", "k")
    light = chunks.select("conv", "part", "k", "front", "back")
    light = light.select("conv", "part", "k", F.lag("back").over(near).alias("left"), "front", F.lead("k").over(near).isNull().alias("last"))
    seam = F.col("left").isNotNull() & ~F.concat("left", "front").isin(*PAIRS)
    marked = chunks.join(light.select("conv", "part", "k", seam.cast("bigint").alias("seam"), "last", (F.col("left").isNotNull() | ~F.col("last")).alias("many")), ["conv", "part", "k"])
    marked = written(marked, "marked")
    return rows, marked, written(edits(marked, fan), "edits")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, sha256, n_rows) of the repaired rows `role:text`, joined by newlines. The rows of a conversation stream through one task in order (a
    digest of their whole cannot be split), which holds one batch of them."""
    kept = edits.where("renamed is not null or added <> ';'").withColumn("t", _turn_key()).drop("turn", "role")
    # a text is needed once, however often its row is repeated; deleted rows need none
    texts = rows.select("conv", _turn_key().alias("t"), "digest", "text").groupBy("conv", "t", "digest").agg(F.first("text").alias("text"))
    lines = kept.join(texts, ["conv", "t", "digest"], "left").select("conv", "part", "k", "i", "renamed", "added", F.when(F.col("renamed").isNotNull(), F.col("text")).alias("text"))
    ordered = lines.repartition("conv").sortWithinPartitions("conv", "part", "k", "i")
    return ordered.mapInArrow(_hashed, "conv string, repaired_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, empty = None, None, True

    def done(names, sums):
        return pa.record_batch([pa.array(names, pa.string()), pa.array(sums, pa.string())], names=["conv", "repaired_sha256"])

    for batch in batches:
        names, sums = [], []
        columns = [batch.column(c).to_pylist() for c in ("conv", "renamed", "added", "text")]
        for at, renamed, added, text in zip(*columns, strict=True):
            if at != conv or state is None:
                if state is not None:
                    names.append(conv)
                    sums.append(state.hexdigest())
                conv, state, empty = at, hashlib.sha256(), True
            front, back = added.split(";")
            lines = [f"{r}:" for r in front.split(",") if r] + ([f"{renamed}:{text}"] if renamed is not None else []) + [f"{r}:" for r in back.split(",") if r]
            if lines:
                state.update(("" if empty else "\n").encode() + "\n".join(lines).encode("utf-8", "surrogatepass"))
                empty = False
        yield done(names, sums)
    if state is not None:
        yield done([conv], [state.hexdigest()])


def audit(turns: DataFrame, originals: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per conversation of `originals` (default: of `turns`): its faults, the cheapest repair and the digest of its result."""
    rows, chunks, steps = plan(turns, conv, turn, role, text, chunk, fan)
    sums = chunks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + F.col("seam")).alias("illegal"))
    spread = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = spread.agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).cast("bigint").alias("gaps"))
    parts = steps.groupBy("conv", "part", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "letters"))), lambda x: x["letters"]), "").alias("letters"))
    costs = steps.groupBy("conv").agg(F.sum("cost").alias("cost"))
    letters = parts.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    base = turns if originals is None else originals
    names = base.select(F.col(conv), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv")).distinct()
    out = names
    for part in (sums, gaps, costs, letters, repaired(rows, steps)):
        out = out.join(part, "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
