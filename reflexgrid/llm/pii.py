"""Personal data by weak supervision.

1. Candidates: the base patterns (email, ip, card, phone) and looser ones of the same and other kinds.
2. Labelers vote for, against, or not at all on each candidate: format, checksum or range, gazetteer, context words, edges.
3. Votes are counted by (kind, votes) over all documents, and expectation-maximisation estimates on these counts how reliable each labeler
   is for each kind and how likely each pattern of votes is right. The number of patterns is bounded by kinds and labelers.
4. A logistic span classifier is trained on all patterns with the estimated probabilities as soft labels, with vote, length and edge
   features. A further span is reported where it says 0.5 or more and no base span overlaps. Base spans always stay.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; repeated rows are searched each; without
candidates in the whole corpus the classifier says no.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_arrow, map_rows, texts, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "key")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# looser patterns: spans that only the trained classifier can accept
LOOSE = (
    ("email", re.compile(r"\b[A-Za-z0-9][\w.+-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}\b")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("key", re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})(?!\w)")),
)

# fixed values: gazetteers and context words
TLDS = frozenset("com org net edu gov info io de fr es it uk eu us ca au jp cn in br nl ch at be pl ru se no dk fi pt mx ar co biz".split())
DIAL_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
FOR = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"), "ip": ("ip", "host", "server", "address", "login", "addr"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"), "phone": ("tel", "phone", "call", "fax", "mobile", "fon", "handy", "appel"),
    "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"), "key": ("token", "key", "secret", "aws", "password", "api"),
}
AGAINST = ("version", "isbn", "invoice", "order", "item", "page", "section", "chapter", "release", "build", "sha", "commit", "md5")
CONTEXT = 32
WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if not any(d in text for d in "0123456789"):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further candidates that no base span overlaps; of overlapping ones the first."""
    found = sorted((m.start(), m.end(), kind) for kind, pattern in LOOSE for m in pattern.finditer(text))
    out, taken, i = [], 0, 0
    for start, end, kind in found:
        while i < len(base) and base[i][1] <= start:
            i += 1
        if start >= taken and not any(b[0] < end and b[1] > start for b in base[i : i + 8]):
            out.append((start, end, kind))
            taken = end
    return out


def _sign(yes: bool | None) -> str:
    return "0" if yes is None else "+" if yes else "-"


def pattern(text: str, start: int, end: int, kind: str, base: bool) -> str:
    """Votes of the five labelers and a few coarse features, as a key with few possible values."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    check = gazetteer = None
    if kind == "email":
        check = ".." not in span and len(span) <= 254
        gazetteer = re.split(r"[. )\]]", span)[-1].lower() in TLDS
    elif kind == "ip":
        parts = [int(p) for p in span.split(".")]
        check = all(p == str(int(p)) for p in span.split("."))
        gazetteer = None if 0 < parts[0] < 224 and parts[0] not in (10, 127) else False
    elif kind == "card":
        check = luhn(digits) and 13 <= len(digits) <= 19
        gazetteer = digits.startswith(CARD_STARTS)
    elif kind == "phone":
        check = len(set(digits)) > 2
        gazetteer = any(digits[:n] in DIAL_CODES for n in (1, 2, 3)) if span[0] == "+" else digits[0] not in "01"
    elif kind == "ssn":
        check = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    elif kind == "iban":
        packed = span.replace(" ", "")
        check = int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    elif kind == "key":
        check = len(set(span)) > 8
        gazetteer = True if span.startswith("AKIA") else None
    before = text[max(0, start - CONTEXT) : start].lower()
    words = WORDS.findall(before)
    context = True if any(w.startswith(FOR[kind]) for w in words) else False if any(w in AGAINST for w in words) else None
    edge = not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())
    votes = _sign(base) + _sign(check) + _sign(gazetteer) + _sign(context) + _sign(edge)
    return f"{kind} {votes} {min(4, (end - start) // 8)} {int(len(digits) * 2 > end - start)}"


def candidates(text: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, base, pattern) in the order of the text."""
    base = base_spans(text)
    both = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
    return [(s, e, k, b, pattern(text, s, e, k, b)) for s, e, k, b in sorted(both, key=lambda x: (x[0], ORDER[x[2]]))]


@dataclass
class Model:
    accepted: dict[str, float] = field(default_factory=dict)  # pattern -> probability
    reliability: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)  # (kind, labeler) -> (yes if right, yes if wrong)

    def takes(self, pattern: str) -> bool:
        return self.accepted.get(pattern, 0.0) >= 0.5


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict]:
    """Expectation-maximisation over counted vote patterns: probability of each (kind, votes), reliability of each labeler by kind."""
    probability: dict[str, float] = {}
    reliability: dict[tuple[str, int], tuple[float, float]] = {}
    for kind in KINDS:
        grouped: Counter = Counter()
        for p, n in counts.items():
            k, votes, *_ = p.split(" ")
            if k == kind:
                grouped[votes] += n
        if not grouped:
            continue
        votes = np.array([["-0+".index(c) - 1 for c in v] for v in grouped])
        n = np.array(list(grouped.values()), float)
        yes, no = votes == 1, votes == -1
        right = 1 / (1 + np.exp(-1.2 * votes.sum(axis=1)))  # start: the majority
        for _ in range(rounds):
            def rate(weight: np.ndarray, prior_yes: float, prior_no: float) -> np.ndarray:
                return ((weight[:, None] * yes).sum(0) + prior_yes) / ((weight[:, None] * (yes | no)).sum(0) + prior_yes + prior_no)

            # priors: a labeler is right more often than wrong
            a, b = rate(n * right, 8, 2), rate(n * (1 - right), 2, 8)
            share = (n @ right + 1) / (n.sum() + 2)
            odds = np.log(share / (1 - share)) + yes @ np.log(a / b) + no @ np.log((1 - a) / (1 - b))
            right = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for v, p in zip(grouped, right, strict=True):
            probability[f"{kind} {v}"] = float(p)
        for i in range(votes.shape[1]):
            reliability[(kind, i)] = (float(a[i]), float(b[i]))
    return probability, reliability


def _features(patterns: list[str]) -> tuple[np.ndarray, list[str]]:
    names = sorted({name for p in patterns for name in _names(p)})
    at = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        for name in _names(p):
            x[i, at[name]] = 1
    return x, names


def _names(p: str) -> list[str]:
    kind, votes, size, share = p.split(" ")
    return [kind, f"{kind} size {size}", f"digits {share}", *(f"{kind} {i}{v}" for i, v in enumerate(votes) if v != "0")]


def fit(counts: dict[str, int]) -> Model:
    """Estimate reliabilities, then train the span classifier on every pattern, weighted by the logarithm of its count."""
    if not counts:
        return Model()
    probability, reliability = estimate(counts)
    patterns = sorted(counts)
    x, _ = _features(patterns)
    soft = np.array([probability[" ".join(p.split(" ")[:2])] for p in patterns])
    weight = np.log1p([counts[p] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - soft)) + 0.05 * w
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    said = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return Model(dict(zip(patterns, said.tolist(), strict=True)), reliability)


def counted(found: DataFrame) -> dict[str, int]:
    """Counts of patterns; their number is bounded by kinds, votes and coarse features."""
    rows = found.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()
    return {r["p"]: r["count"] for r in rows}


def _found(df: DataFrame, key: str, text: str) -> DataFrame:
    def each(keys: list, batch: list[str]) -> dict:
        held("nothing")
        out: dict = {"key": keys, "spans": [], "base": [], "patterns": []}
        for t in batch:
            c = candidates(t)
            out["spans"].append([f"{k}:{s}:{e}" for s, e, k, _, _ in c])
            out["base"].append([b for _, _, _, b, _ in c])
            out["patterns"].append([p for *_, p in c])
        return out

    rows = texts(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, spans array<string>, base array<boolean>, patterns array<string>", each)


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and n_more (spans that the classifier added).

    The candidates are written once (offsets and patterns, no texts); training and the result read them from there.
    """
    found = written(_found(df, key, text), "candidates")
    model = fit(counted(found))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: dict = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more")}
            for spans, base, patterns in zip(rows["spans"], rows["base"], rows["patterns"], strict=True):
                own = [s for s, b in zip(spans, base, strict=True) if b]
                kept = [s for s, b, p in zip(spans, base, patterns, strict=True) if b or model.takes(p)]
                n = Counter(s.partition(":")[0] for s in own)
                for kind in BASE:
                    out[f"n_{kind}"].append(n[kind])
                out["base_sha256"].append(hashlib.sha256(",".join(own).encode()).hexdigest())
                out["spans"].append(",".join(kept))
                out["n_more"].append(len(kept) - len(own))
            fields = [batch.column(0), *(pa.array(out[f"n_{k}"], pa.int64()) for k in BASE), pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["n_more"], pa.int64())]
            yield pa.record_batch(fields, names=["key", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_more"])

    kind = found.schema["key"].dataType.simpleString()
    result = in_arrow(found, each, f"key {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_more bigint")
    return result.withColumnRenamed("key", key)


def mask(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with each span of the text replaced by its kind in brackets; null texts stay null.

    The counts of patterns are taken from the same table first. `n_chars`, if there is such a column, is set to the new length."""
    model = fit(counted(_found(df.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text")))
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text) if text in df.columns else [c.lower() for c in df.columns].index(text.lower())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nothing")
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                new = [None if t is None else _masked(t, shared.value) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    out = in_arrow(df, each, df.schema)
    if n_chars and n_chars in df.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNotNull(), F.length(text).cast(df.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*df.columns)


def _masked(text: str, model: Model) -> str:
    out, at = [], 0
    for start, end, kind, base, p in candidates(text):
        if start < at:  # of overlapping spans, what is left of the later one goes too
            at = max(at, end)
            continue
        if base or model.takes(p):
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])
