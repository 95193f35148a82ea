"""Best-fit packing planned on the length histogram.

1. Each text becomes pieces of at most `capacity` tokens (only longer documents are cut) with the checksum of their ids.
2. Pieces are counted by length. The histogram has at most `capacity` rows whatever the corpus.
3. Best-fit decreasing runs over counts: bins of equal free space are one entry, equal lengths are placed together. The plan is a
   list of slot ranges (length, first rank, last rank, first sequence, offset, slots per sequence); its size depends on the capacity alone.
4. Every piece gets its rank among the pieces of its length and takes the slot of that rank.

Ranks come from windows over (length, salt), a salt being a hash of the key, plus the sizes of the salts before; so no length,
however common, meets in one task.

Defined results: a null or empty text is one piece that holds the end mark alone; repeated rows are packed each; an empty table gives
no rows. A key may be null.
"""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, map_rows, texts, written

SPECIAL = "<|endoftext|>"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
ODD = re.compile(r"[^\S \n]|\0")


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes, with a bounded cache of words.

    A word boundary of the tokenizer always lies before a space that a non-space follows, so a text is cut there and the ids of the
    parts are put together."""

    def __init__(self, path: str, size: int = 150_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = size
        self.fast = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary for the faster library, if its ranks are the ids; else None."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
        if not plain:
            return None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast else self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(self.words) >= self.size:
            self.old, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text or not self.fast:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text[-1:] in " \n" or ODD.search(text):
            return self._encode(text)  # the cut could fall inside a word of the tokenizer
        words = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        get = self.words.get
        return b"".join([get(w) or self._word(w) for w in words if w])


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: (length, rank from, rank to, first sequence, offset, slots per sequence).

    Rank r of the range goes to sequence first + (r - from) // slots at offset + (r - from) % slots * length."""
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences (first, how many)
    spaces: list[int] = []
    out, opened = [], 0

    def give(space: int, run: tuple[int, int]) -> None:
        if space and run[1]:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            each = space // length
            full = min(many, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, capacity - space, each))
                rank, left = rank + full * each, left - full * each
                give(space - full_space(each, length), (first, full))
            if full < many and left:  # fewer than one sequence can take
                out.append((length, rank, rank + left, first + full, capacity - space, left))
                give(space - left * length, (first + full, 1))
                full, left = full + 1, 0
            if full < many:
                give(space, (first + full, many - full))
    return out


def full_space(each: int, length: int) -> int:
    return each * length


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32. The first piece takes what is left over, later ones are full."""
    tail = np.array([end], dtype="<u4").tobytes()

    def each(keys: list, batch: list[str]) -> dict:
        encode = encoder(path)
        out: dict = {"key": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for k, t in zip(keys, batch, strict=True):
            ids = encode(t) + tail
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                out["key"].append(k)
                out["piece"].append(i)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[4 * a : 4 * b]))
        return out

    rows = texts(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", each, 128)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, salt_rows: int = 50_000) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset. `salt_rows`: pieces per salt, on average over all lengths."""
    spark = df.sparkSession
    cut = written(pieces(df, path, key, text, capacity, end), "pieces")
    by_length = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(by_length.values())
    salts = max(256, total // salt_rows)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)))
    ranked = cut.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece", "start")) - 1)
    sizes = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    slots = spark.createDataFrame(plan(by_length, capacity), "length bigint, rank_from bigint, rank_to bigint, first bigint, at bigint, each bigint")
    rank = F.col("local") + F.col("before")
    inside = F.col("rank") - F.col("rank_from")
    placed = ranked.withColumn("rank", rank).join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(inside / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(inside, F.col("each")) * F.col("length")).alias("offset"),
    )
