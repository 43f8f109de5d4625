"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import table
from weldsight.llm.html_pages import NAMES, labelled_pages

#: Labelled pages that the model is trained on, and steps of the training.
TRAIN_PAGES, STEPS = 700, 150

#: Kinds of elements as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mpadded mphantom mtable mtr mtd merror semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul dd dt td th tr tbody thead tfoot".split())
#: Controls and drawings, and the starts that end an unclosed one; foreignobject keeps those inside it.
ENDED_BY = {"button": CLOSES_P - {"div"}, "select": CLOSES_P, "svg": CLOSES_P, "foreignobject": frozenset()}
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
TAGS = ("text", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "fieldset", "blockquote", "pre", "table", "tr", "td", "th", "tbody", "thead", "figure", "figcaption", "dl", "dt", "dd", "body", "html", "address", "details", "dialog", "menu", "search", "button", "select", "option", "svg")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z", re.S)
_NAME = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"\bhidden\b(?!-)|display\s*:\s*none", re.I)

_BY_WORD = {"nav": "nav", "menu": "nav", "navbar": "nav", "navigation": "nav", "breadcrumb": "nav", "breadcrumbs": "nav", "header": "header", "masthead": "header", "topbar": "header", "footer": "footer", "copyright": "footer", "colophon": "footer", "sidebar": "side", "side": "side", "widget": "side", "related": "side", "rail": "side", "popular": "side", "recommended": "side", "ad": "ad", "ads": "ad", "advert": "ad", "advertisement": "ad", "sponsored": "ad", "sponsor": "ad", "promo": "ad", "banner": "ad", "cookie": "notice", "consent": "notice", "notice": "notice", "alert": "notice", "popup": "notice", "modal": "notice", "newsletter": "notice", "subscribe": "notice", "paywall": "notice", "gdpr": "notice", "comment": "comment", "comments": "comment", "reply": "comment", "replies": "comment", "disqus": "comment", "discussion": "comment", "responses": "comment", "kommentar": "comment", "kommentare": "comment", "commentaire": "comment", "commentaires": "comment", "comentario": "comment", "comentarios": "comment", "commenti": "comment", "reacties": "comment", "komentarze": "comment", "share": "share", "social": "share", "tags": "share", "toolbar": "share", "pagination": "share", "content": "content", "article": "content", "post": "content", "entry": "content", "story": "content", "body": "content"}
_KINDS = tuple(NAMES)
_FEATURES = [f"tag:{t}" for t in TAGS] + ["tag:other"] + [f"name:{k}" for k in _KINDS] + [f"links:{i}" for i in range(4)] + [f"size:{i}" for i in range(6)] + [f"stops:{i}" for i in range(3)] + [f"share:{i}" for i in range(5)] + [f"anchors:{i}" for i in range(3)] + ["no name", "hidden", "repeated", "headed", "after", "before", "layout"]
_AT = {f: i for i, f in enumerate(_FEATURES)}
#: Kinds of edges, by the child: a text in its element, a part of a page, a part of an article, or another element; then
#: one whose name says what it is, one of several alike, and one beside a much larger one.
_EDGE = {**dict.fromkeys(("nav", "aside", "header", "footer", "form", "fieldset", "dialog", "menu", "search"), 1), **dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table", "tbody", "tr", "td", "th", "figure", "figcaption", "dl", "dt", "dd"), 2), "text": 0}
EDGES = 7
#: Elements that parts of a page come in, and those of tables: a table that holds parts lays the page out.
CONTAINERS = frozenset("div section article main aside table td ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("table thead tbody tfoot tr td th".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol div section article main aside table blockquote pre".split())


class Tree:
    """Block elements and texts of a page in page order: parents, features, the texts' blocks and training labels."""

    def __init__(self, page: str):
        self.parent: list[int] = [-1]
        self.tags: list[str] = ["html"]
        self.kinds: list[set[str]] = [set()]
        self.label: list[bool] = [False]
        self.blocks: dict[int, str] = {}
        self.linked: dict[int, float] = {}
        self.anchors: dict[int, int] = {}
        self._parse(page)
        self.layout = self._layout()
        self.hollow = self._hollow()

    def _node(self, parent: int, tag: str, attributes: str) -> int:
        kinds = set()
        if attributes:
            for m in _NAME.finditer(attributes):
                for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
                    if w in _BY_WORD:
                        kinds.add(_BY_WORD[w])
            if _HIDDEN.search(attributes):
                kinds.add("hidden")
        self.parent.append(parent)
        self.tags.append(tag)
        self.kinds.append(kinds)
        self.label.append("data-label" in attributes)
        return len(self.parent) - 1

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]
        run: list[str] = []
        in_link, linked, anchors = 0, 0, 0
        controls: list[int] = []

        def flush() -> None:
            nonlocal linked, anchors
            if run:
                text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
                if text:
                    at = self._node(stack[-1][1], "text", "")
                    self.label[at] = self.label[stack[-1][1]]
                    self.blocks[at], self.linked[at], self.anchors[at] = text, min(1.0, linked / len(text)), anchors
                run.clear()
            linked = anchors = 0

        #: Where the open elements of each name are in the stack, so that no tag has to walk it.
        places: defaultdict[str, list[int]] = defaultdict(list)

        def nearest(names: tuple[str, ...]) -> int:
            return max((places[n][-1] for n in names if places[n]), default=0)

        def pop(to: int) -> None:
            nonlocal in_link
            flush()
            for open_name, _ in stack[to:]:
                places[open_name].pop()
            del stack[to:]
            while controls and controls[-1] >= to:
                controls.pop()
            in_link = 0

        at = 0
        while True:
            m = _TOKEN.search(page, at)
            data = page[at : m.start() if m else len(page)]
            if data:
                run.append(data)
                if in_link:
                    linked += len(data.strip())
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
            if name in RAW and not closing:
                end = _END[name].search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else len(page)
                run.append(" ")
                continue
            if name in VOID:
                if name == "br" or name == "hr":
                    run.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                    anchors += in_link
                continue
            if closing:
                if places[name]:
                    pop(places[name][-1])
                else:
                    flush()
                continue
            flush()
            if name in ("html", "body") and len(stack) == 1:
                self.label[0] |= "data-label" in attributes
                continue
            if controls and name in ENDED_BY[stack[controls[-1]][0]]:
                pop(controls[-1])
            if name in CLOSES_P and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name in PEERS:
                while (peer := nearest(PEERS[name])) > nearest(FENCES[name]):
                    pop(peer)
                    if name != "tr":
                        break
            # only drawings have elements that end with their own tag
            if not (attributes.endswith("/") and (name == "svg" or places["svg"])):
                if name in ENDED_BY:
                    controls.append(len(stack))
                places[name].append(len(stack))
                stack.append((name, self._node(stack[-1][1], name, attributes)))
        flush()

    def _layout(self) -> list[bool]:
        """Which nodes belong to a table that lays out parts of the page instead of figures."""
        n = len(self.parent)
        table, lays = [-1] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            table[i] = i if self.tags[i] == "table" else table[p]
            if self.tags[i] in PARTS and self.tags[p] in ("td", "th") and table[p] >= 0:
                lays[table[p]] = True
        return [self.tags[i] in CELLS and table[i] >= 0 and lays[table[i]] for i in range(n)]

    def _hollow(self) -> list[bool]:
        """Elements without a known name around one element alone, which say nothing: their child takes their place."""
        n = len(self.parent)
        inside, text = [0] * n, [False] * n
        for i in range(1, n):
            inside[self.parent[i]] += 1
            text[self.parent[i]] |= self.tags[i] == "text"
        return [i > 0 and self.tags[i] in ("div", "section") and not self.kinds[i] and inside[i] == 1 and not text[i] for i in range(n)]

    def _beside(self, chars: list[int]) -> list[set[str]]:
        """What each node is beside its siblings: a container ``after`` or ``before`` one of four times its size, or
        ``repeated``: a container of several parts whose neighbour has the same ones (``headed`` if a heading comes first)."""
        n = len(self.parent)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parent[i]].append(i)
        shape = [tuple(self.tags[c] for c in own) if len(own) > 1 and tag in ("div", "section", "article", "li") else () for own, tag in zip(children, self.tags, strict=True)]
        out: list[set[str]] = [set() for _ in range(n)]
        for own in children:
            for name, order in (("after", own), ("before", own[::-1])):
                most, last = 0, -1
                for i in order:
                    if self.tags[i] in CONTAINERS:
                        if 4 * chars[i] < most:
                            out[i].add(name)
                        most = max(most, chars[i])
                    if shape[i] and last >= 0 and self.tags[last] == self.tags[i] and shape[last] == shape[i]:
                        out[i].add("headed" if shape[i][0] in HEADINGS else "repeated")
                    if self.tags[i] != "text":
                        last = i
        return out

    def features(self) -> list[list[int]]:
        n = len(self.parent)
        chars, linked, stops, anchors = [0] * n, [0.0] * n, [0] * n, [0] * n
        for i, text in self.blocks.items():
            chars[i], linked[i], stops[i], anchors[i] = len(text), self.linked[i] * len(text), text.count(". ") + text.count(", ") + text.endswith("."), self.anchors[i]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            anchors[p] += anchors[i]
        beside = self._beside(chars)
        for i in range(1, n):
            if self.hollow[self.parent[i]]:
                beside[i] |= beside[self.parent[i]]
        out: list[list[int]] = []
        for i in range(n):
            if self.hollow[i]:
                out.append([])
                continue
            tag = self.tags[i]
            f = [_AT.get(f"tag:{tag}", _AT["tag:other"])]
            kinds = self.kinds[i]
            f += [_AT[f"name:{k}"] for k in kinds if f"name:{k}" in _AT]
            if "hidden" in kinds:
                f.append(_AT["hidden"])
            if not kinds and tag in ("div", "section", "ul", "ol"):
                f.append(_AT["no name"])
            f += [_AT[name] for name in sorted(beside[i])]
            if self.layout[i]:
                f.append(_AT["layout"])
            if anchors[i]:
                mean = linked[i] / anchors[i]
                f.append(_AT[f"anchors:{0 if mean < 15 else 1 if mean < 30 else 2}"])
            share = linked[i] / chars[i] if chars[i] else 0.0
            f.append(_AT[f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}"])
            f.append(_AT[f"size:{min(5, int(math.log(chars[i] + 1, 4)))}"])
            part = chars[i] / chars[0] if chars[0] else 0.0
            f.append(_AT[f"share:{0 if part < 0.05 else 1 if part < 0.3 else 2 if part < 0.6 else 3 if part < 1 else 4}"])
            dense = 100 * stops[i] / chars[i] if chars[i] else 0.0
            f.append(_AT[f"stops:{0 if dense == 0 else 1 if dense < 1.5 else 2}"])
            out.append(f)
        return out


@dataclass
class Forest:
    """Trees side by side as arrays; levels are the nodes of each depth."""

    parent: np.ndarray
    edge: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, trees: list[Tree]) -> Forest:
        parent, edge, node, feature, base = [], [], [], [], 0
        for t in trees:
            above = list(t.parent)
            for i, f in enumerate(t.features()):
                p = above[i]
                if p >= 0 and t.hollow[p]:
                    above[i] = p = above[p]  # those of hollow elements are known by then
                if t.hollow[i]:
                    parent.append(-1)
                else:
                    parent.append(p + base if p >= 0 else -1)
                kind = 4 if t.kinds[i] & set(_KINDS) - {"content"} else 3 if t.layout[i] else 5 if _AT["repeated"] in f else 6 if _AT["after"] in f else _EDGE.get(t.tags[i], 3)
                edge.append(kind)
                node.extend([base + i] * len(f))
                feature.extend(f)
            base += len(t.parent)
        up = np.array(parent, np.int64)
        depth = np.zeros(base, np.int64)
        for i, p in enumerate(parent):  # parents come before children
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if base else []
        return cls(up, np.array(edge, np.int64), np.array(node, np.int64), np.array(feature, np.int64), levels)


def marginals(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over the trees: each node's probability of content, and each edge's joint one (parent, child).

    weights: the log potential of label 1 for each feature. edges: log potentials by kind of edge, parent, child.
    """
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.node, weights[forest.feature], n) if n else 0.0
    potential = edges[forest.edge]
    up, message = own.copy(), np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        both = potential[level] + up[level][:, None, :]
        message[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        # nodes of a level are in page order, so that those of a parent are side by side
        parents = forest.parent[level]
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        up[parents[first]] += np.add.reduceat(message[level], first)
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        cavity = belief[forest.parent[level]] - message[level]
        both = cavity[:, :, None] + potential[level]
        belief[level] = up[level] + np.logaddexp(both[:, 0], both[:, 1])
        whole = both + up[level][:, None, :]
        top = whole.max(axis=(1, 2), keepdims=True)
        e = np.exp(whole - top)
        joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def train(pages: list[str], steps: int = STEPS, rate: float = 0.15, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Potentials that make the labels of the pages likely: gradient ascent on the exact log likelihood (Adam)."""
    trees = [Tree(p) for p in pages]
    forest = Forest.of(trees)
    truth = np.array([x for t in trees for x in t.label], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    kinds = forest.edge[child]
    seen = np.bincount(4 * kinds + 2 * truth[forest.parent[child]] + truth[child], minlength=4 * EDGES).reshape(EDGES, 2, 2)
    size = len(_FEATURES)
    params = np.zeros(size + 4 * EDGES)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, steps + 1):
        weights, edges = params[:size], params[size:].reshape(EDGES, 2, 2)
        p, joint = marginals(forest, weights, edges)
        slope = np.bincount(forest.feature, (truth - p)[forest.node], size)
        expected = np.stack([np.bincount(kinds, joint[child, a, b], EDGES) for a in (0, 1) for b in (0, 1)], 1).reshape(EDGES, 2, 2)
        grad = np.concatenate([slope, (seen - expected).ravel()]) / len(trees) - ridge * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        params = params + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return params[:size], params[size:].reshape(EDGES, 2, 2)


def main_texts(pages: list[str], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    """The texts of each page whose marginal is one half or more, in page order, joined by line breaks."""
    trees = [Tree(p) for p in pages]
    p, _ = marginals(Forest.of(trees), weights, edges)
    out, base = [], 0
    for t in trees:
        out.append("\n".join(text for i, text in t.blocks.items() if p[base + i] >= 0.5))
        base += len(t.parent)
    return out


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page: its main text from the whole html.

    Null and empty pages have an empty text, as have pages without content; broken markup is read as far as it goes;
    repeated rows are pages of their own; an empty table gives no rows; other columns are not read. White space inside
    a block (line breaks included) is one space and blocks are joined by a line break.
    """
    weights, edges = train(labelled_pages(train_pages, varied=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = main_texts(b.column("html").to_pylist(), weights, edges)
                columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
