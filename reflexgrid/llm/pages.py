"""Main text of web pages by a tree-structured graphical model.

Nodes are the block elements of a page and its blocks of text, each in one of two states, content or not. A node's own potential
comes from its tag, class words, text size, link share and punctuation; a compatibility table ties every node to its parent.
Messages are passed up to the root and down again (sum-product, exact on a tree), and the text of a block counts as content if its
marginal is at least 0.5.

Training. Labelled pages are those with exactly one `article` or `main` element: what is in it is content, but for navigation, forms
and the like inside. Each is used twice, once as it is and once with these elements read as `div`, so that the model learns to do
without them. Weights are fitted by penalised logistic regression around prior values (fixed below), the table from counted pairs of
parent and child states.

Defined results: null and empty pages, and pages without text, give an empty text; repeated rows are read each; broken markup is read
to its end, tags that never end are dropped.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: classes of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object canvas math select audio video noframes xmp".split())
BLOCK = frozenset(
    "html body main article section nav aside header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption"
    " address form fieldset legend table caption thead tbody tfoot tr td th details summary dialog menu center hr option button label search".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption button label option legend summary dt dd li".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("ul ol dl table html body article section div aside nav header footer main form td th".split())
MAIN = frozenset(("article", "main"))
BAD_TAGS = frozenset("nav aside footer form header menu button label fieldset dialog search".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adv sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar side widget rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal"
    " overlay comment comments reply replies respond discussion disqus share sharing social follow related recommended recommendations more"
    " newsletter subscribe subscription signup login search form pagination pager tags tagcloud copyright legal disclaimer skip hidden".split()
)
GOOD_WORDS = frozenset("article content post entry story main text body hentry articlebody".split())
PRIOR = {
    "bias": 0.5, "bad tag": -7.0, "bad word": -7.0, "in bad": -7.0, "main tag": 3.0, "in main": 2.0, "good word": 1.5, "heading": 1.0, "paragraph": 1.0,
    "links most": -3.0, "links some": -0.5, "long": 1.5, "sentences": 1.0, "rights": -4.0, "root": -1.0,
}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z](?:[^\"'>]|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*(?:>|$)", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<=[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/>"'])""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MARKS = re.compile(r"[.!?,;:](?=\s|$)")
RIGHTS = re.compile(r"©|\(c\)\s|all rights reserved|copyright", re.I)


class Node:
    __slots__ = ("parent", "tag", "words", "text", "size", "linked", "marks", "bad", "main", "hidden")

    def __init__(self, parent: int, tag: str, words: frozenset = frozenset(), text: str | None = None):
        self.parent, self.tag, self.words, self.text = parent, tag, words, text
        self.size = self.linked = self.marks = 0
        self.bad = self.main = self.hidden = False


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; text nodes hold one block of text each, white space already folded."""
    nodes = [Node(-1, "html")]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements: name, nearest block node
    buffer: list[str] = []
    anchored = 0  # characters of the buffer inside links
    anchors = 0

    def flush() -> None:
        nonlocal anchored
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                node = Node(stack[-1][1], "#text", text=text)
                node.size, node.linked, node.marks = len(text), min(len(text), anchored), len(MARKS.findall(text))
                nodes.append(node)
            buffer.clear()
        anchored = 0

    def pop_to(depth: int) -> None:
        nonlocal anchors
        while len(stack) > depth:
            anchors -= stack[-1][0] == "a"
            stack.pop()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            piece = html.unescape(page[at:start])
            buffer.append(piece)
            if anchors:
                anchored += len(piece)
        if not m:
            break
        token, at = m[0], m.end()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                buffer.append(token[9:].removesuffix("]]>"))
            continue
        if token[-1] != ">":
            break  # the page ends inside a tag
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            if name == "br":
                buffer.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name not in BLOCK and depth and any(s[0] in BLOCK for s in stack[depth + 1 :]):
                continue  # an inline end tag does not close blocks
            if depth:
                if name in BLOCK:
                    flush()
                pop_to(depth)
            continue
        if name in RAW:
            if not token.endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                buffer.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
            if name in ("html", "body"):
                if name == "body" and len(nodes) == 1:
                    nodes.append(Node(0, "body", _words(token)))
                    stack.append(("body", 1))
                continue
            if name in CLOSES_P:
                depth = _open(stack, ("p",), FENCE)
                if depth:
                    pop_to(depth)
            if name in SAME:
                depth = _open(stack, SAME[name], FENCE - {"td", "th"} if name == "tr" else FENCE)
                if depth:
                    pop_to(depth)
            nodes.append(Node(stack[-1][1], name, _words(token)))
            nodes[-1].hidden = _hidden(token)
            stack.append((name, len(nodes) - 1))
        elif not token.endswith("/>"):
            anchors += name == "a"
            stack.append((name, stack[-1][1]))
    flush()
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.size += node.size
        above.linked += node.linked
        above.marks += node.marks
    for i in _wrappers(nodes):
        nodes[i].words -= BAD_WORDS
    for node in nodes[1:]:  # what holds for a node holds below it
        above = nodes[node.parent]
        node.bad = above.bad or above.tag in BAD_TAGS or bool(above.words & BAD_WORDS) or above.hidden
        node.main = above.main or above.tag in MAIN
    return nodes


def _wrappers(nodes: list[Node]) -> set[int]:
    """Nodes whose names say nothing of what they hold: those around the page's first main element, or, on a page without any, around
    half of its text or more."""
    at = next((i for i, n in enumerate(nodes) if n.tag in MAIN), None)
    if at is None:
        return {i for i, n in enumerate(nodes) if 2 * n.size >= nodes[0].size}
    out = {0}
    while at:
        at = nodes[at].parent
        out.add(at)
    return out


def _open(stack: list, names: tuple, fence: frozenset) -> int:
    """Depth of an open element of these names, up to the next fence; 0 if there is none."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            return i
        if stack[i][0] in fence:
            return 0
    return 0


def _words(token: str) -> frozenset:
    if "=" not in token:
        return frozenset()
    found = [v.strip("\"'") for k, v in ATTRIBUTE.findall(token) if k.lower() in ("class", "id", "role")]
    return frozenset(WORD.findall(CAMEL.sub(" ", " ".join(found)).lower()))


def _hidden(token: str) -> bool:
    return any(k.lower() == "hidden" or k.lower() == "style" and re.search(r"display\s*:\s*none", v, re.I) for k, v in ATTRIBUTE.findall(token))


def features(node: Node, masked: bool = False) -> list[str]:
    """Names of the features of a node; with `masked`, as if `article` and `main` were `div`."""
    out = ["bias"]
    if node.tag in BAD_TAGS:
        out.append("bad tag")
    if node.words & BAD_WORDS or node.hidden:
        out.append("bad word")
    elif node.words & GOOD_WORDS:
        out.append("good word")
    if node.bad:
        out.append("in bad")
    if not masked:
        if node.tag in MAIN:
            out.append("main tag")
        if node.main:
            out.append("in main")
    if node.tag in ("html", "body"):
        out.append("root")
    elif node.tag in ("h1", "h2", "h3", "h4"):
        out.append("heading")
    elif node.tag in ("p", "blockquote", "pre"):
        out.append("paragraph")
    elif node.tag in ("ul", "ol", "li", "dl", "table", "tr", "td"):
        out.append("list")
    share = node.linked / node.size if node.size else 0.0
    out.append("links most" if share > 0.5 else "links some" if share > 0.2 else "links few")
    out.append("long" if node.size >= 200 else "middle" if node.size >= 60 else "short")
    if node.marks >= 2:
        out.append("sentences")
    if node.text is not None:
        out.append("text")
        if node.size < 300 and RIGHTS.search(node.text):
            out.append("rights")
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    table: tuple = ((0.5, -1.5), (-0.5, 1.0))  # log compatibility of parent state, child state

    def marginals(self, nodes: list[Node], masked: bool = False) -> list[float]:
        """Probability of content for each node, by messages up and down the tree."""
        n, t, w = len(nodes), self.table, self.weights
        own = [sum(w.get(f, 0.0) for f in features(node, masked)) for node in nodes]  # log odds
        e = [[math.exp(v) for v in row] for row in t]
        gather, sent = own[:], [0.0] * n  # log odds below and at each node; message to its parent
        for i in range(n - 1, 0, -1):
            x = math.exp(max(-60.0, min(60.0, gather[i])))
            sent[i] = math.log((e[1][0] + e[1][1] * x) / (e[0][0] + e[0][1] * x))
            gather[nodes[i].parent] += sent[i]
        full = gather[:]
        for i in range(1, n):
            p = nodes[i].parent
            x = math.exp(max(-60.0, min(60.0, full[p] - sent[i])))
            full[i] = gather[i] + math.log((e[0][1] + e[1][1] * x) / (e[0][0] + e[1][0] * x))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, v)))) for v in full]

    def extract(self, page: str) -> str:
        nodes = parse(page)
        said = self.marginals(nodes)
        return " ".join(node.text for node, p in zip(nodes, said, strict=True) if node.text is not None and p >= 0.5)


def labels(nodes: list[Node]) -> list[int] | None:
    """1 for nodes in or at the only main element of a page, outside of navigation and the like; None for pages without just one."""
    if sum(node.tag in MAIN for node in nodes) != 1:
        return None
    good = [0] * len(nodes)
    for i, node in enumerate(nodes):
        inside = node.tag in MAIN or node.parent >= 0 and node.main and good[node.parent]
        good[i] = int(bool(inside) and node.tag not in BAD_TAGS and not node.words & BAD_WORDS)
    return good


def fit(pages: list[str], strength: float = 2.0) -> Model:
    """Weights and table from labelled pages; without any, the prior values."""
    counts: Counter = Counter()
    pairs = np.ones((2, 2))
    for page in pages:
        nodes = parse(page)
        good = labels(nodes)
        if good is None:
            continue
        for i, node in enumerate(nodes):
            if i:
                pairs[good[node.parent], good[i]] += 1
            for masked in (False, True):
                counts[(tuple(features(node, masked)), good[i])] += 1
    if not counts:
        return Model()
    names = sorted({f for key, _ in counts for f in key} | set(PRIOR))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    y, weight = np.zeros(len(counts)), np.zeros(len(counts))
    for r, ((key, good), n) in enumerate(sorted(counts.items())):
        x[r, [at[f] for f in key]] = 1
        y[r], weight[r] = good, n
    weight *= 200 / weight.sum()  # the pages count as much as 200 nodes against the prior
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + (w - prior) / strength
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.eye(len(w)) / strength
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    joint = pairs / pairs.sum()
    table = np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -2, 2)
    return Model(dict(zip(names, w.tolist(), strict=True)), tuple(map(tuple, table.tolist())))


def train(df: DataFrame, page: str = "html", sample: int = 300) -> Model:
    """Fit on at most `sample` labelled pages, chosen by a hash of the page."""
    usable = df.select(F.col(page).alias("html")).where(F.lower("html").rlike("<(article|main)[ >]")).withColumn("mark", F.xxhash64("html"))
    # the smallest hashes first, as numbers alone: tasks never send pages that are not taken
    marks = [r["mark"] for r in usable.select("mark").distinct().orderBy("mark").limit(sample).collect()]
    if not marks:
        return fit([])
    chosen = usable.where(F.col("mark") <= marks[-1]).groupBy("mark").agg(F.min("html").alias("html"))
    return fit([r["html"] for r in chosen.orderBy("mark").collect()])


def main_text(df: DataFrame, model: Model, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: key, the kept columns, text, n_chars (code points). Pages are read where they are, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = df.select(F.col(key).alias("key"), F.coalesce(F.col(page), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out = [shared.value.extract(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *part.columns[2:], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["key", *(f"keep_{c}" for c in keep), "text", "n_chars"])

    out = own.mapInArrow(run, ", ".join(["key " + kinds["key"], *(f"`keep_{c}` " + kinds[f"keep_{c}"] for c in keep), "text string, n_chars bigint"]))
    return out.select(F.col("key").alias(key), *(F.col(f"keep_{c}").alias(c) for c in keep), "text", "n_chars")
