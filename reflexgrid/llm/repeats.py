"""Removal of repeated passages by hashing lines and parts of lines.

Units. A text is cut at line breaks. The units of a line are its sentences of `min_words` words or more; each shorter sentence together with as many short ones
behind it as make `min_words` words; of sentences of more than `long_words` words the pieces between words whose hash (with the word
before) meets a fixed condition; and the whole line, if it has several sentences. Each unit depends on its own words alone, so a passage gives the
same units wherever it stands, but for pieces at its ends. Units overlap. They are normalised (case folded, one space between words) and digested
to 128 bits; what has under `min_words` words is left alone.

Occurrences are ranked by key, then by place. The earliest one of each digest stays in the corpus, all others are removed.

All units are written once (digest, key, place, offsets, no texts). Digests are counted with partial aggregation. Digests that make up
more than 1/2000 of all units, so at most 2,000, are joined by broadcast; the rest, of which none is large, by a shuffle.

Defined results: null and empty texts have no units; rows of equal key are one document, so a repeated row keeps what the first one keeps;
null keys rank first. A column `kept` of the input is replaced. Offsets are code points of the text as given, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, texts, written

WORD = re.compile(r"\S+")
ENDS = ".!?"
LONG_CUT = 8  # one of so many words of a long sentence is followed by a cut


def parts(words: list[str], min_words: int, long_words: int) -> list[tuple[int, int]]:
    """First and last word (exclusive) of the units of a line, from its normalised words."""
    n = len(words)
    ends = [i + 1 for i, w in enumerate(words) if w[-1] in ENDS or i + 1 == n]
    sentences = list(zip([0, *ends], ends, strict=False))
    out = []
    for k, (a, b) in enumerate(sentences):
        if b - a > long_words:
            marks = [i + 1 for i in range(a + 1, b - 1) if zlib.crc32(f"{words[i - 1]} {words[i]}".encode("utf-8", "surrogatepass")) % LONG_CUT == 0]
            out += zip([a, *marks], [*marks, b], strict=True)
        elif b - a >= min_words:
            out.append((a, b))
        else:
            for _, end in sentences[k + 1 :]:
                if end - b >= min_words:  # a sentence that is a unit by itself
                    break
                b = end
                if b - a >= min_words:
                    out.append((a, b))
                    break
    return list(dict.fromkeys(out + [(0, n)] * (len(sentences) > 1)))


def units(text: str, min_words: int = 6, long_words: int = 24) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the units with enough words."""
    at = 0
    for line in text.split("\n"):
        spans = [m.span() for m in WORD.finditer(line)]
        if len(spans) >= min_words:
            words = [line[a:b].casefold() for a, b in spans]
            for i, j in parts(words, min_words, long_words):
                if j - i >= min_words:
                    body = " ".join(words[i:j]).encode("utf-8", "surrogatepass")
                    yield at + spans[i][0], at + spans[j - 1][1], hashlib.blake2b(body, digest_size=16).digest()
        at += len(line) + 1


def removals(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 6, long_words: int = 24) -> DataFrame:
    """One row per removed unit: key, unit, start, end, first_key, first_start (of the occurrence that stays)."""

    def each(keys: list, batch: list[str]) -> dict:
        out: dict = {"high": [], "low": [], "key": [], "unit": [], "start": [], "end": []}
        for k, t in zip(keys, batch, strict=True):
            for n, (a, b, digest) in enumerate(units(t, min_words, long_words)):
                out["high"].append(int.from_bytes(digest[:8], "big", signed=True))
                out["low"].append(int.from_bytes(digest[8:], "big", signed=True))
                out["key"].append(k)
                out["unit"].append(n)
                out["start"].append(a)
                out["end"].append(b)
        return out

    rows = texts(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    found = written(map_rows(rows, f"high bigint, low bigint, key {kind}, unit int, start bigint, end bigint", each), "units")
    counted = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("first"))
    again = written(counted.where("n > 1").select("high", "low", "n", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start")), "repeated")
    total = found.count()
    common = again.where(F.col("n") * 2000 > total)  # at most 2,000 rows
    rare = again.where(F.col("n") * 2000 <= total)
    digest = ["high", "low"]
    hot = found.join(F.broadcast(common), digest)
    cold = found.join(F.broadcast(common.select(*digest)), digest, "left_anti").join(rare, digest)
    stays = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("start") == F.col("first_start"))
    out = hot.unionByName(cold).where(~stays)
    return out.select(F.col("key").alias(key), "unit", "start", "end", F.col("first_key").alias("first_" + key), "first_start")


def cleaned(df: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `df` with the removed units cut out of the text, and `kept`, the spans (start, end) of the text as it was
    that remain, in order. The removed spans of one key meet in one row; they are bounded by its own text."""
    df = df.drop("kept")
    spans = removed.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__cut"))
    both = df.join(spans, df[key].eqNullSafe(spans["__key"]), "left").drop("__key")
    n, k, names = both.columns.index(text), both.columns.index("__cut"), [*df.columns, "kept"]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField("kept", T.ArrayType(span))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            new, kept = [], []
            for t, gone in zip(batch.column(n).to_pylist(), batch.column(k).to_pylist(), strict=True):
                if t is None:
                    new.append(None)
                    kept.append([])
                    continue
                left, at = [], 0
                for span in gone or ():
                    if span["start"] > at:
                        left.append((at, span["start"]))
                    at = max(at, span["end"])
                if at < len(t):
                    left.append((at, len(t)))
                new.append("".join(t[a:b] for a, b in left))
                kept.append([{"start": a, "end": b} for a, b in left])
            columns = [c for i, c in enumerate(batch.columns) if i != k]
            columns[n] = pa.array(new, batch.schema.field(n).type)
            yield pa.record_batch([*columns, pa.array(kept, spans)], names=names)

    return both.mapInArrow(cut, schema)
