"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystrom landmarks.

Units. A text is lower-cased and split at white space; a run of three or more single characters ("i d i o t") is one unit. Inside a
unit, digits and signs that stand for letters are read as such, other non-letters are left out, and a mark stands for the word start.

Kernel. K(u, v) sums over all common subsequences of ORDER characters the decay to the power of their spans in u and in v, so gaps and
inserted characters weaken a match without ending it. A unit of over WINDOW characters is covered by windows that overlap by half.

Sentences. A sentence is its units; its score is that of its strongest unit, and a text's that of its strongest sentence. Training is
that of a multiple-instance machine: every unit of a clean sentence is clean; of toxic documents the strongest sentence and all others
beyond the margin are taken as labelled toxic by their strongest units, and these choices are made anew after each fit. Landmarks are the character strings that mark toxic documents
best, chosen until they cover them, and frequent clean strings. Gapped and inserted variants of toxic units are trained on as well.

Defined results: null and empty texts, and texts without letters, have the score of a text without any match. Without toxic labels
all scores are 0. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import held, in_arrow, map_rows, texts

ORDER, DECAY = 4, 0.6
WINDOW = 40
COMMON = 3
NEAR = 0.4
PLAIN = 3  # landmarks that are frequent clean strings
START = "<"
# fixed values: signs that are read as letters inside a word
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
INNER = re.compile(r"[\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
NOTHING = -4.0  # score of a unit that matches no landmark


def units(text: str) -> list[str]:
    text = text.lower()
    found = text.split()
    return found + ["".join(m.split()) for m in SPACED.findall(text)]


def spelled(unit: str) -> str:
    """The letters of a unit, with a start mark; empty without letters."""
    inner = EDGE.sub("", unit)
    if not inner.isalpha():
        inner = INNER.sub("", inner.translate(LOOKALIKE))
    return START + inner if inner else ""


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """K of each pair left[i], right[i]; all pairs at once, one pass over the characters of the longest."""
    n, m = max(map(len, left)), max(map(len, right))
    a, b = _codes(left, n, 0xFFFFFFFF), _codes(right, m, 0xFFFFFFFE)
    lam = np.float32(DECAY)
    total = np.zeros(len(left), np.float32)
    # inner[i][j]: sum over common subsequences of i characters of the first part of `left` and the first j characters of `right`,
    # spans counted to the ends of both
    inner = [[np.ones(len(left), np.float32) for _ in range(m + 1)]] + [[np.zeros(len(left), np.float32) for _ in range(m + 1)] for _ in range(ORDER - 1)]
    for x in range(n):
        same = [(a[x] == b[j]).astype(np.float32) * (lam * lam) for j in range(m)]
        for j in range(ORDER - 1, m):
            total += same[j] * inner[ORDER - 1][j]
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(len(left), np.float32)
            row, below = inner[i], inner[i - 1]
            for j in range(m):
                run = lam * run + same[j] * below[j]
                row[j + 1] = lam * row[j + 1] + run
    return total


def _codes(words: list[str], size: int, fill: int) -> np.ndarray:
    """Code points, one row per place."""
    out = np.full((len(words), size), fill, np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(size) < lengths[:, None]] = flat
    return np.ascontiguousarray(out.T)


def _shapes(words: list[str]) -> np.ndarray:
    """A 256-bit set per word of its character pairs, next to each other or with one character between."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    of = np.repeat(np.arange(len(words)), lengths)
    out = np.zeros((4, len(words)), np.uint64)
    for step in (1, 2):
        bit = np.full(len(flat), 256, np.uint64)
        if len(flat) > step:
            inside = of[:-step] == of[step:]
            bit[:-step][inside] = ((flat[:-step] * np.uint64(0x9E3779B1) + flat[step:] * np.uint64(0x85EBCA6B)) >> np.uint64(7))[inside] & np.uint64(255)
        for part in range(4):
            mine = np.where(bit >> np.uint64(6) == part, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            out[part] |= np.bitwise_or.reduceat(mine, starts)
    return out


class Features:
    """Kernel values with the landmarks, of the best window of each word, in units of the landmark's own.

    A value counts as 0 if word and landmark have under COMMON close character pairs in common, or if the kernel of the whole word is
    not over NEAR times that of the landmark with itself."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.own = kernel(landmarks, landmarks)
        self.shapes = _shapes(landmarks)

    def pairs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, value) for all values above 0."""
        parts = [part for w in words for part in windows(w)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        of = np.arange(len(parts))
        if len(parts) != len(words):
            of = np.repeat(np.arange(len(words)), [len(windows(w)) for w in words])
        shapes = _shapes(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        rows, cols = [], []
        for j in range(len(self.landmarks)):
            hit = np.flatnonzero(sum(np.bitwise_count(shapes[k] & self.shapes[k, j]) for k in range(4) if self.shapes[k, j]) >= COMMON)
            rows.append(hit)
            cols.append(np.full(len(hit), j))
        row, col = np.concatenate(rows), np.concatenate(cols)
        order = np.argsort(lengths[row], kind="stable")  # pairs of like lengths together, so that little is padding
        row, col = row[order], col[order]
        values = np.zeros(len(row))
        for at in range(0, len(row), 8192):
            r, c = row[at : at + 8192], col[at : at + 8192]
            values[at : at + 8192] = kernel([parts[i] for i in r], [self.landmarks[j] for j in c]) / self.own[c]
        near = values > NEAR
        return of[row[near]], col[near], self._windowed([parts[i] for i in row[near]], col[near])

    def _windowed(self, words: list[str], col: np.ndarray) -> np.ndarray:
        """The largest kernel value of a window of the word, one character longer than the landmark, over that of the landmark itself."""
        if not words:
            return np.zeros(0)
        cut = [[w[i : i + len(self.landmarks[j]) + 1] for i in range(max(1, len(w) - len(self.landmarks[j])))] for w, j in zip(words, col, strict=True)]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat, lands = [w for ws in cut for w in ws], np.repeat(col, sizes)
        values = np.zeros(len(flat))
        for at in range(0, len(flat), 8192):
            c = lands[at : at + 8192]
            values[at : at + 8192] = kernel(flat[at : at + 8192], [self.landmarks[j] for j in c]) / self.own[c]
        return np.maximum.reduceat(values, np.r_[0, np.cumsum(sizes)[:-1]])

    def matrix(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)))
        r, c, v = self.pairs(words)
        np.maximum.at(out, (r, c), v)
        return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the landmark values, Nystrom map and machine in one
    bias: float
    slope: float = 1.0  # from a unit's distance to a probability
    middle: float = 0.0

    def __post_init__(self):
        self.features = Features(self.landmarks) if self.landmarks else None

    def unit_scores(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        if self.features and words:
            known = [i for i, w in enumerate(words) if w]
            x = self.features.matrix([words[i] for i in known])
            out[known] += x @ self.weights
        return out

    def probability(self, distance: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.asarray(distance) - self.middle), -30, 30)))


def choose_landmarks(toxic: list[list[str]], clean: Counter, n_clean: int, most: int, plain: int = PLAIN) -> tuple[list[str], list[str]]:
    """Strings of 4 to 10 characters that mark toxic documents, and some frequent clean strings.

    Of all strings the one with the largest likelihood ratio (longer ones weigh more) is taken in turn, and the units that hold it are
    explained; the others count on without them. It ends where no ratio holds against the number of strings looked at."""
    sizes = (4, 5, 6, 8, 10)
    df: Counter = Counter(w for words in toxic for w in words if clean[w] <= 0.01 * n_clean)
    holds = defaultdict(set)
    for w in df:
        for size in sizes:
            for i in range(len(w) - size + 1):
                holds[w[i : i + size]].add(w)
    looked = len(holds)
    count = {s: k for s, words in holds.items() if (k := sum(df[w] for w in words)) >= 3}
    other: Counter = Counter()
    for w, n in clean.items():
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (s := w[i : i + size]) in count:
                    other[s] += n
    share = len(toxic) / (len(toxic) + n_clean)

    docs_of = defaultdict(set)
    for d, words in enumerate(toxic):
        for w in words:
            if w in df:
                docs_of[w].add(d)

    def ratio(s: str) -> float:
        if count[s] < 3 or count[s] * -np.log(share) <= 1.2 * np.log(looked):
            return 0.0  # no number of documents could do
        k, o = len(set().union(*(docs_of[w] for w in holds[s]))), other[s]
        if k / len(toxic) < 10 * o / max(1, n_clean):
            return 0.0
        return k * np.log(k / ((k + o) * share)) + (o * np.log(o / ((k + o) * (1 - share))) if o else 0)

    value = {s: v for s in count if (v := ratio(s)) > 1.2 * np.log(looked)}
    chosen: list[str] = []
    while value and len(chosen) < most - plain:
        best = max(value, key=lambda s: (value[s] * len(s) ** 0.5, s))
        chosen.append(best)
        touched = set()
        for w in list(holds[best]):
            for size in sizes:
                for i in range(len(w) - size + 1):
                    s = w[i : i + size]
                    if s in count and w in holds[s]:
                        holds[s].discard(w)
                        count[s] -= df[w]
                        touched.add(s)
        for s in touched & value.keys():
            value[s] = ratio(s)
            if value[s] <= 1.2 * np.log(looked):
                del value[s]
    return chosen, [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) >= ORDER + 1][:plain]


def variants(word: str, seed: int) -> list[str]:
    """The word with one letter inserted, and with one letter doubled; places follow from the seed."""
    rng = np.random.default_rng(seed)
    if len(word) < 5:
        return []
    at, letter = int(rng.integers(2, len(word))), chr(97 + int(rng.integers(26)))
    return [word[:at] + letter + word[at:], word[:at] + word[at - 1] + word[at:]]


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the support vectors."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(z), bool)
    for _ in range(rounds):
        za, wa = z[active], weight[active] * cost
        w = np.linalg.solve(ridge + za.T @ (za * wa[:, None]), za.T @ (wa * y[active]))
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit(docs: list[tuple[int, list[list[str]]]], landmarks: int = 48, rounds: int = 2, negatives: int = 15_000) -> Model:
    """Train on (label, sentences), a sentence being a list of spelled units."""
    flat = _without_copies([(label, sorted({u for s in sentences for u in s if u})) for label, sentences in docs])
    toxic = [words for label, words in flat if label and words]
    clean: Counter = Counter(u for label, words in flat if not label for u in words)
    if not toxic:
        return Model([], np.zeros(0), NOTHING)
    telling, ordinary = choose_landmarks(toxic, clean, len(flat) - sum(label for label, _ in flat), landmarks)
    if not telling:
        return Model([], np.zeros(0), NOTHING)
    marks = telling + ordinary
    features = Features(marks)
    # Nystrom: map kernel values k(u, .) by the inverse root of the landmarks' own kernel matrix
    grid = features.matrix(marks)
    grid = (grid + grid.T) / 2
    value, vector = np.linalg.eigh(grid)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T

    rare = sorted(clean, key=lambda w: hash_of(w))[: negatives * 4]
    pool = features.matrix(rare)
    hardest = np.argsort(-pool.max(axis=1), kind="stable")[:negatives]
    xn = pool[hardest] @ root
    near = pool[hardest].max(axis=1) > 0.5  # clean look-alikes weigh half of all clean units, however few they are
    wn = np.where(near, 1 / max(1, near.sum()), 1 / max(1, (~near).sum()))
    # candidates are the units of toxic documents that clean ones lack; at first those near a toxic landmark are taken as toxic
    spotted = sorted({w for words in toxic for w in words if not clean[w]})
    at = {w: i for i, w in enumerate(spotted)}
    xs = features.matrix(spotted)
    close = xs[:, : len(telling)].max(axis=1)
    guide = close - 0.75
    w, b, more = np.zeros(len(marks)), NOTHING, []
    for _ in range(rounds):
        take = set(np.flatnonzero((guide > 0) & (close > 0.6)).tolist())
        for words in toxic:  # and the strongest one of each toxic document, if it is near at all
            own = [at[w] for w in words if w in at]
            if own and close[best := max(own, key=lambda i: guide[i])] > 0.6:
                take.add(best)
        if not take:
            break
        more = [v for i in sorted(take) for v in variants(spotted[i], i)]
        xp = np.vstack([xs[sorted(take)], features.matrix(more)]) @ root
        x = np.vstack([xp, xn])
        y = np.r_[np.ones(len(xp)), -np.ones(len(xn))]
        weight = np.r_[np.full(len(xp), 0.3 / len(xp)), wn * (0.7 / wn.sum())] * 3000
        w, b = machine(x, y, weight)
        guide = xs @ (root @ w) + b
    model = Model(marks, root @ w, b)
    every = sorted({w for _, words in flat for w in words})
    known = dict(zip(every, model.unit_scores(every).tolist(), strict=True))
    flat = [(label, words) for label, words in flat if not label or any(known[w] > -0.5 for w in words)]  # others show nothing of what is toxic
    strongest = np.array([max(map(known.__getitem__, words)) if words else b for _, words in flat] + model.unit_scores(more[: len(toxic) // 12]).tolist())
    label = np.array([label for label, _ in flat] + [1] * len(more[: len(toxic) // 12]))  # variants count as toxic texts
    model.slope, model.middle = calibrate(strongest, label)
    return model


def _without_copies(docs: list[tuple[int, list[str]]], size: int = 12, shared: int = 4) -> list[tuple[int, list[str]]]:
    """Documents whose smallest unit hashes are mostly those of one before would count the same words twice; they are left out."""
    kept, of = [], defaultdict(list)
    for label, words in docs:
        marks = sorted(map(hash_of, words))[:size]
        met = Counter(d for m in marks for d in of[m])
        if met and met.most_common(1)[0][1] >= min(shared, len(marks)):
            continue
        for m in marks:
            of[m].append(len(kept))
        kept.append((label, words))
    return kept


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def calibrate(distance: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and middle of a logistic curve over the distances, fitted with smoothed targets and class weights."""
    n1, n0 = label.sum(), (1 - label).sum()
    if not n1 or not n0:
        return 1.0, float(distance.max(initial=0.0)) + (1.0 if not n1 else -1.0)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * distance + c, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        z = np.c_[distance, np.ones(len(distance))]
        step = np.linalg.solve(z.T @ (z * h[:, None]) + 1e-6 * np.eye(2), z.T @ g)
        size = min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        a, c = a - size * step[0], c - size * step[1]
        if np.abs(step).max() < 1e-6:
            break
    a = max(a, 1e-3)
    return float(a), float(-c / a)


def train(sample: DataFrame, landmarks: int = 48) -> Model:
    """Fit on a bounded sample of (label, text)."""

    def each(labels: list, batch: list[str]) -> dict:
        out: dict = {"label": labels, "sentences": []}
        for t in batch:
            # the distinct units of each sentence, in the order of the text
            out["sentences"].append("\n".join(dict.fromkeys(" ".join(dict.fromkeys(spelled(u) for u in units(s))) for s in SENTENCE.split(t))))
        return out

    rows = map_rows(sample.select("label", "text"), "label int, sentences string", each).collect()
    rows = sorted((r["label"], r["sentences"]) for r in rows)
    return fit([(label, [s.split(" ") for s in text.split("\n")]) for label, text in rows], landmarks)


class Scorer:
    """Scores texts with a model; the scores of known units are kept in two bounded dictionaries, of which the older goes."""

    def __init__(self, model: Model, size: int = 100_000):
        self.model, self.size, self.young, self.old = model, size, {}, {}

    def distances(self, batch: list[str]) -> list[float]:
        cut = [units(t) for t in batch]
        young, old = self.young, self.old
        fresh = {u for us in cut for u in us if u not in young}
        for u in fresh & old.keys():
            young[u] = old[u]
        new = [u for u in fresh if u not in young]
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            young.update(zip(some, self.model.unit_scores([spelled(u) for u in some]).tolist(), strict=True))
        out = [max(map(young.__getitem__, us)) if us else self.model.bias for us in cut]
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


def scorer(shared) -> Scorer:
    """The worker's scorer for a broadcast model."""
    return held(f"toxicity {shared.id}", lambda: Scorer(shared.value))


class Shared:
    """A broadcast model with an identity that workers can tell apart."""

    def __init__(self, spark, model: Model):
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast((model.landmarks, model.weights, model.bias, model.slope, model.middle))

    @property
    def value(self) -> Model:
        return Model(*self.held.value)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1, higher: toxic likelier). The model holds some tens of landmarks whatever the corpus."""
    shared = Shared(df.sparkSession, model)

    def each(keys: list, batch: list[str]) -> dict:
        s = scorer(shared)
        return {"key": keys, "score": s.model.probability(np.array(s.distances(batch), float)).tolist()}

    rows = texts(df, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    return map_rows(rows, f"key {kind}, score double", each).withColumnRenamed("key", key)


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `df`, all columns, whose text scores under the threshold; rows with null texts stay."""
    shared, at = Shared(df.sparkSession, model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                said = s.model.probability(np.array(s.distances([t or "" for t in part.column(at).to_pylist()]), float))
                yield part.filter(pc.or_(pa.array(said < threshold), pc.is_null(part.column(at))))

    return in_arrow(df, run, df.schema)
