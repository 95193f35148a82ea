"""Token counts by rank-synchronous merging over ragged numpy arrays.

A text is cut where no piece of the vocabulary can reach across: before each space that follows a non-space, and around line breaks.
The distinct units of a batch that the worker has not met yet become one flat array of symbol ids with a sequence number each. In
every round all sequences at once apply their best pair (lowest rank, leftmost on ties), finished sequences leave, and at the end the
symbols that survive are counted. Characters outside the vocabulary count one token for each UTF-8 byte.

Defined results: null and empty texts have 0 tokens and 0 bytes; a null key stays a row of its own; repeated rows are counted each.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import held, map_rows, texts

SPACE = "▁"
NONE = np.int64(2**62)
LONG = 64  # sequences longer than this apply all places of a safe pair in one round


class Merger:
    """Merge ranks of a sentencepiece BPE model as sorted numpy arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        scores = {i: model.get_score(i) for i in ids.values()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.of_code = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_code[ord(piece)] = i
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in ids)
        self.breaks = not any("\n" in p for p in ids)
        pairs = {}
        for piece, whole in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[scores[whole]], whole)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = keys
        self.rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.whole = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        # a pair is safe to apply in several places at once if no extension of its result could come before it
        best = {}
        for k in keys.tolist():
            for side in (k >> 32, k & 0xFFFFFFFF):
                best[side] = min(best.get(side, len(rank)), pairs[k][0])
        self.safe = np.array([best.get(pairs[k][1], len(rank)) > pairs[k][0] for k in keys.tolist()], dtype=bool)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the rank table, -1 where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit (already in the model's spelling: spaces as its space mark)."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        flat = self.of_code[code]
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        seq = np.repeat(np.arange(len(units)), sizes)
        odd = flat < 0
        out = np.bincount(seq[odd], weights=1 + (code[odd] > 0x7F) + (code[odd] > 0x7FF) + (code[odd] > 0xFFFF), minlength=len(units)).astype(np.int64)
        while len(flat):
            row = np.full(len(flat), -1)
            inside = np.flatnonzero(seq[:-1] == seq[1:])
            row[inside] = self.find(flat[inside], flat[inside + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[starts, len(flat)])
            place = np.arange(len(flat)) - np.repeat(starts, length)
            order = np.where(row >= 0, (self.rank[row] << 32) | place, NONE)
            best = np.minimum.reduceat(order, starts)
            done = best == NONE
            if done.any():  # what is left of these sequences is final
                known = np.add.reduceat((flat >= 0).astype(np.int64), starts)
                out[seq[starts[done]]] += known[done]
            hit = starts[~done] + (best[~done] & 0xFFFFFFFF)
            many = (~done) & (length > LONG)
            if many.any():
                hit = np.r_[hit, self._more(row, order, starts, length, best, many)]
                hit.sort()
            flat[hit] = self.whole[row[hit]]
            keep = np.repeat(~done, length)
            keep[hit + 1] = False
            flat, seq = flat[keep], seq[keep]
        return out

    def _more(self, row, order, starts, length, best, many) -> np.ndarray:
        """Further places of the chosen pair in long sequences, if the pair is safe; of overlapping ones every second."""
        chosen = starts[many] + (best[many] & 0xFFFFFFFF)
        wanted = np.where(self.safe[row[chosen]], row[chosen], -2)
        of = np.repeat(np.arange(int(many.sum())), length[many])
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[many], length[many], strict=True)])
        at = at[row[at] == wanted[of]]
        if not len(at):
            return at
        run = np.r_[True, np.diff(at) != 1]
        within = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        return np.setdiff1d(at[within % 2 == 0], chosen)


def _worker(path: str) -> tuple[Merger, dict, dict]:
    """The merge tables, and the unit counts known so far: young and old."""
    return held(f"counts {path}", lambda: (Merger(path), {}, {}))


CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def count_batch(path: str, batch: list[str], size: int = 150_000) -> list[int]:
    """Tokens of each text. Unit counts are kept in two bounded dictionaries per worker, the older of which goes when the younger is full."""
    model, young, old = _worker(path)
    cut = []
    for text in batch:
        if not text:
            cut.append(())
        elif model.inner_space:
            cut.append([SPACE + text.replace(" ", SPACE)])
        else:
            parts = [text] if not model.breaks else text.split("\n")
            units = []
            for i, part in enumerate(parts):
                part = part if i else " " + part  # the model writes a space before the text
                if "  " in part or part[-1:] == " " or SPACE in part:  # several spaces together: cut by the full rule
                    units += CUT.split(part.replace(" ", SPACE))
                else:
                    units += part.replace(" ", " " + SPACE).split(" ")
            if len(parts) > 1:
                units += ["\n"] * (len(parts) - 1)
            cut.append(units)
    fresh = {u for units in cut for u in units if u not in young}
    if fresh:
        for u in fresh & old.keys():
            young[u] = old[u]
        new = [u for u in fresh if u not in young]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            young.update(zip(some, model.counts(some).tolist(), strict=True))
    out = [sum(map(young.__getitem__, units)) for units in cut]
    if len(young) > size:
        old.clear()
        old.update(young)
        young.clear()
    return out


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). `path` must be readable on every executor."""

    def each(keys: list, batch: list[str]) -> dict:
        n = count_batch(path, batch)
        return {"key": keys, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in batch], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = texts(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", each).withColumnRenamed("key", key)
