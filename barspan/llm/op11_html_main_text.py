"""Main text of raw web pages: boosted trees over the nodes of the page, decoded along the tree.

Every block and every text run of a page (``htmltree``) gets features: length and density of its
subtree, link share, punctuation, depth, place in the page, what its siblings and its parent look
like, and how often its attribute tokens and its tag stand for main text. Gradient-boosted trees give each
node three probabilities: all of its text is main text, none is, or some is. Decoding picks the
likeliest consistent choice for the whole tree: below a node that is taken whole everything is taken, below
a node that is left out nothing is, and only below a mixed node the children decide.

The model is trained on ``LAYOUTS`` generated pages (``op11_layouts``), once per process that calls
``extract``; the generated pages are a documented parameter and no row of the table is learnt from. It is a
table of about 100 small trees, sent to the workers.

The text of a block is its decoded text with white space (``str.split``) turned into single spaces; a line break
element counts as white space, inline elements as nothing; blocks are joined by one space in page order.

Nulls: a null or empty html, and a page without main text, give an empty text. A null id or url is
returned. Repeated rows give repeated rows. An empty table gives no rows. Pages of any length and depth are read
whole (``htmltree.DEPTH``). Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm import op11_layouts
from barspan.llm.common import modest_batches
from barspan.llm.htmltree import HEADINGS, Page, read
from barspan.llm.textops import tidy

#: Generated pages to learn from, trees per class, their depth, bins per feature, step length, and every how manyth node a tree grows on.
LAYOUTS, ROUNDS, DEPTH, BINS, RATE, EVERY = 800, 32, 4, 32, 0.3, 4
IN, OUT, MIXED = 0, 1, 2
#: Characters of a run that counts as prose.
LONG = 80
#: Characters of pages whose nodes are scored together.
GROUP = 4 << 20
RESULT = "page_id long, url string, text string, n_chars long"


class Nodes:
    """The nodes of several pages in one set of arrays; parents stand before their children."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.n = int(sizes.sum())
        cat = lambda name: [x for p in pages for x in getattr(p, name)]
        parent = np.array(cat("parent"), np.int64).reshape(-1)
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.first, sizes))
        self.tag, self.tokens, self.text = cat("tag"), cat("tokens"), cat("text")
        self.link_chars, self.links, self.controls = (np.array(cat(k), float).reshape(-1) for k in ("link_chars", "links", "controls"))
        self.depth = np.zeros(self.n, np.int64)
        order = np.arange(self.n)
        at, level = np.where(self.parent >= 0, self.parent, -1), 0
        while (at >= 0).any():
            level += 1
            self.depth += at >= 0
            at = np.where(at >= 0, self.parent[at], -1)
        by = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[by], np.arange(level + 2))
        self.levels = [order[by[a:b]] for a, b in zip(cuts, cuts[1:])]

    def up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = own.astype(float).copy()
        for rows in self.levels[:0:-1]:
            np.add.at(total, self.parent[rows], total[rows])
        return total


@functools.lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a digit, and whether it is a capital."""
    points = [chr(i) for i in range(0x110000)]
    return np.array([*map(str.isdigit, points)]), np.array([*map(str.isupper, points)])


def _run_counts(texts: list[str]) -> np.ndarray:
    """Characters, words, marks of sentences, digits, capitals and prose characters of each run."""
    out = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        if t:
            n = len(t)
            out[i] = n, t.count(" ") + 1, t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";") + t.count("。") + t.count("，"), 0, 0, n if n >= LONG else 0
    if len(texts):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(out[:, 0]).astype(np.int64)
        for column, kind in zip((3, 4), _kinds()):
            upto = np.concatenate([[0], np.cumsum(kind[points])])
            out[:, column] = upto[ends] - upto[ends - out[:, 0].astype(np.int64)]
    return out


class Tokens:
    """How often a tag or an attribute token stands for main text, none of it, or some."""

    def __init__(self, tokens: list[tuple[str, ...]], label: np.ndarray, weight: np.ndarray):
        seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for names, k, w in zip(tokens, label.tolist(), weight.tolist()):
            if w:
                for t in names:
                    seen[t][k] += 1
        total = sum(seen.values(), np.zeros(3)) + 1
        prior = np.log(total[IN] / total[OUT]), np.log(total[MIXED] / (total[IN] + total[OUT]))
        self.value = {
            t: (math.log((c[IN] + 1) / (c[OUT] + 1)) - prior[0] * 0.3, math.log((c[MIXED] + 1) / (c[IN] + c[OUT] + 1)) - prior[1] * 0.3) for t, c in seen.items() if c.sum() >= 3
        }

    def features(self, tokens: list[tuple[str, ...]]) -> np.ndarray:
        """Sum, least and greatest odds of main text, and sum of those of mixed."""
        out = np.zeros((len(tokens), 4))
        memo: dict[tuple[str, ...], tuple] = {}
        for i, names in enumerate(tokens):
            if names:
                row = memo.get(names)
                if row is None:
                    got = [self.value[t] for t in names if t in self.value] or [(0.0, 0.0)]
                    row = memo[names] = (sum(g[0] for g in got), min(g[0] for g in got), max(g[0] for g in got), sum(g[1] for g in got))
                out[i] = row
        return out


def features(nodes: Nodes, tokens: Tokens) -> np.ndarray:
    n, parent = nodes.n, nodes.parent
    is_run = np.array([not t for t in nodes.tag], bool)
    chars, words, marks, digits, capitals, prose = (nodes.up(c) for c in _run_counts(nodes.text).T)
    link_chars, links, controls = nodes.up(nodes.link_chars), nodes.up(nodes.links), nodes.up(nodes.controls)
    blocks, runs = nodes.up(~is_run), nodes.up(is_run)
    tag = np.array(nodes.tag, object)
    paragraphs, items = nodes.up(tag == "p"), nodes.up(tag == "li")
    headings = nodes.up(np.array([t in HEADINGS for t in nodes.tag], bool))
    has = parent >= 0
    up = np.where(has, parent, 0)
    some = np.maximum(chars, 1)
    density = link_chars / some
    page_chars = np.bincount(nodes.page, weights=np.where(has, 0, chars), minlength=int(nodes.page[-1]) + 1 if n else 0)[nodes.page]
    own = np.where(is_run, chars, 0)
    before = np.cumsum(own) - own
    begin = before - before[nodes.first[nodes.page]]
    # siblings: children of one parent, or the top nodes of one page
    family = np.where(has, parent + int(nodes.page[-1]) + 1, nodes.page)
    _, family = np.unique(family, return_inverse=True)
    k = int(family.max()) + 1
    count = np.bincount(family, minlength=k)
    family_chars = np.bincount(family, weights=chars, minlength=k)
    family_links = np.bincount(family, weights=link_chars, minlength=k)
    most = np.zeros(k)
    np.maximum.at(most, family, chars)
    order = np.argsort(family, kind="stable")
    place = np.zeros(n)
    place[order] = np.arange(n) - (np.cumsum(count) - count)[family[order]]
    previous, following = np.full(n, -1), np.full(n, -1)
    same = family[order][1:] == family[order][:-1]
    previous[order[1:][same]], following[order[:-1][same]] = order[:-1][same], order[1:][same]
    _, kind = np.unique(np.array(nodes.tag), return_inverse=True)
    twin = family * (int(kind.max()) + 1) + kind
    _, twin_at, twin_n = np.unique(twin, return_inverse=True, return_counts=True)
    named = tokens.features(nodes.tokens)
    tagged = tokens.features([(f"<{t or 'text'}>",) for t in nodes.tag])
    # sums and least odds along the ancestors, the node included
    chain, least, highest = named[:, 0] + tagged[:, 0], np.minimum(named[:, 1], tagged[:, 1]), np.maximum(named[:, 2], tagged[:, 2])
    # the closest tag or token on the way up that tells much, and how far it is
    both = np.column_stack([named[:, 1], named[:, 2], tagged[:, 1]])
    near = both[np.arange(n), np.abs(both).argmax(1)]
    near, far = np.where(np.abs(near) > 1, near, 0.0), np.zeros(n)
    for rows in nodes.levels[1:]:
        above = near[rows] == 0
        far[rows] = np.where(above, far[parent[rows]] + 1, 0)
        near[rows] = np.where(above, near[parent[rows]], near[rows])
        chain[rows] += chain[parent[rows]]
        least[rows] = np.minimum(least[rows], least[parent[rows]])
        highest[rows] = np.maximum(highest[rows], highest[parent[rows]])
    inner = nodes.up((named[:, 0] + tagged[:, 0]) * 1.0) - named[:, 0] - tagged[:, 0]
    side = lambda which, x: np.where(which >= 0, x[np.maximum(which, 0)], -1)
    log = np.log1p
    return np.column_stack(
        [
            log(chars), density, log(chars / (blocks + 1)), log(chars / np.maximum(runs, 1)), prose / some, 100 * marks / some, chars / np.maximum(words, 1), digits / some, capitals / some,
            chars / np.maximum(page_chars, 1), chars / np.maximum(np.where(has, chars[up], page_chars), 1),
            nodes.depth, begin / np.maximum(page_chars, 1), (begin + chars) / np.maximum(page_chars, 1), log(blocks), log(runs), log(links), log(controls), controls / np.maximum(blocks, 1),
            log(paragraphs), log(items), log(headings), is_run, count[family], place / np.maximum(count[family] - 1, 1), chars / np.maximum(most[family], 1), (family_links / np.maximum(family_chars, 1))[family],
            twin_n[twin_at] / count[family], np.where(has, density[up], -1), np.where(has, (prose / some)[up], -1), side(previous, log(chars)), side(following, log(chars)), side(previous, density), side(following, density),
            named[:, 0], named[:, 1], named[:, 2], named[:, 3], tagged[:, 0], tagged[:, 3], chain, least, highest, near, far, inner / (blocks + runs),
            side(previous, named[:, 0] + tagged[:, 0]), side(following, named[:, 0] + tagged[:, 0]), np.where(has, (named[:, 0] + tagged[:, 0])[up], 0),
        ]
    )


class Trees:
    """Complete trees over binned features: (feature, bin) of each inner node and the value of each leaf."""

    def __init__(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.binned(x)
        n = len(x)
        score = np.zeros((n, 3))
        target = np.eye(3)[label]
        self.feature, self.cut, self.leaf = [], [], []
        for i in range(rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            some = np.arange(i % EVERY, n, EVERY)
            for k in range(3):
                g, h = weight * (p[:, k] - target[:, k]), weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                feature, cut = self._grow(binned[some], g[some], h[some])
                at = self._leaves(binned, feature, cut)
                value = -RATE * np.bincount(at, weights=g, minlength=2**depth) / (np.bincount(at, weights=h, minlength=2**depth) + 1)
                score[:, k] += value[at]
                self.feature.append(feature)
                self.cut.append(cut)
                self.leaf.append(value)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level by level the split of greatest gain; a node without one sends all rows left."""
        n, f = binned.shape
        place = binned.astype(np.int64) + np.arange(f) * BINS
        weights = np.repeat(g, f), np.repeat(h, f)
        feature, cut, at = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS, np.int64), np.zeros(n, np.int64)
        for d in range(self.depth):
            width = 2**d
            key = (place + (at * (f * BINS))[:, None]).ravel()
            left = [np.bincount(key, weights=v, minlength=width * f * BINS).reshape(width, f, BINS).cumsum(2) for v in weights]
            total = [s[:, :1, -1:] for s in left]
            right = [t - s for t, s in zip(total, left)]
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
            gain[(left[1] < 1) | (right[1] < 1)] = 0
            gain = gain.reshape(width, -1)
            best, rows = gain.argmax(1), width - 1 + np.arange(width)
            good = gain.max(1) > 1e-3
            feature[rows], cut[rows] = np.where(good, best // BINS, 0), np.where(good, best % BINS, BINS)
            at = 2 * at + (binned[np.arange(n), feature[rows[at]]] > cut[rows[at]])
        return feature, cut

    def _leaves(self, binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        return at - (2**self.depth - 1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]).astype(np.uint8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        score = np.zeros((len(x), 3))
        for i, (feature, cut, leaf) in enumerate(zip(self.feature, self.cut, self.leaf)):
            score[:, i % 3] += leaf[self._leaves(binned, feature, cut)]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


def decode(nodes: Nodes, logp: np.ndarray) -> np.ndarray:
    """Which nodes are taken: the likeliest choice without contradiction between ancestors and descendants."""
    is_run = np.array([not t for t in nodes.tag], bool)
    empty = nodes.up(np.array([len(t) for t in nodes.text], float)) == 0
    children = np.bincount(nodes.parent[nodes.parent >= 0], minlength=nodes.n)
    alone = is_run & (nodes.parent >= 0) & (children[np.maximum(nodes.parent, 0)] == 1)
    logp = np.where((empty | alone)[:, None], 0.0, logp)  # boxes without text say nothing, a run alone nothing beyond its block
    whole, none, mixed = logp[:, IN].copy(), logp[:, OUT].copy(), np.where(is_run, -np.inf, logp[:, MIXED])
    for rows in nodes.levels[:0:-1]:
        up = nodes.parent[rows]
        np.add.at(whole, up, whole[rows])
        np.add.at(none, up, none[rows])
        np.add.at(mixed, up, np.maximum(np.maximum(whole[rows], none[rows]), mixed[rows]))
    state = np.zeros(nodes.n, np.int64)
    for d, rows in enumerate(nodes.levels):
        free = np.argmax(np.column_stack([whole[rows], none[rows], mixed[rows]]), axis=1)
        above = state[nodes.parent[rows]] if d else np.full(len(rows), MIXED)
        state[rows] = np.where(above == MIXED, free, above)
    return state == IN


class Model:
    def __init__(self, layouts: int = LAYOUTS, seed: int = 11, rounds: int = ROUNDS):
        pages = [read(h) for h in op11_layouts.pages(layouts, seed)]
        nodes = Nodes(pages)
        label, weight = _labels(pages, nodes)
        names = [(f"<{t or 'text'}>", *k) for t, k in zip(nodes.tag, nodes.tokens)]
        fold = nodes.page % 2
        x = np.zeros((nodes.n, 0))
        for k in (0, 1):  # token odds of a page come from the other half of the pages
            got = features(nodes, Tokens(names, label, weight * (fold != k)))
            x = got if not x.shape[1] else np.where((fold == k)[:, None], got, x)
        keep = weight > 0
        self.trees = Trees(x[keep], label[keep], weight[keep], rounds)
        self.tokens = Tokens(names, label, weight)

    def main_texts(self, sources: list[str | None]) -> list[str]:
        """Main text of each page."""
        out, at = [""] * len(sources), 0
        while at < len(sources):
            to, size = at, 0
            while to < len(sources) and (to == at or size + len(sources[to] or "") <= GROUP):
                size += len(sources[to] or "")
                to += 1
            nodes = Nodes([read(s) for s in sources[at:to]])
            if nodes.n:
                taken = decode(nodes, self.trees.log_probabilities(features(nodes, self.tokens)))
                pieces: dict[int, list[str]] = defaultdict(list)
                for i in np.flatnonzero(taken).tolist():
                    if nodes.text[i]:
                        pieces[int(nodes.page[i])].append(nodes.text[i])
                for p, texts in pieces.items():
                    out[at + p] = " ".join(texts)
            at = to
        return out


def _labels(pages: list[Page], nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """(in, out or mixed; weight) of each node of marked pages; boxes without text weigh nothing."""
    marks: list[str] = []
    for p in pages:
        marks += (p.marks + [""] * len(p.tag))[: len(p.tag)]
    state = np.array([{"in": 1, "out": 0}.get(m, -1) for m in marks])
    for rows in nodes.levels:
        up = np.where(nodes.parent[rows] >= 0, state[np.maximum(nodes.parent[rows], 0)], 0)
        state[rows] = np.where(state[rows] < 0, up, state[rows])
    size = np.array([len(t) for t in nodes.text], float)
    total, main = nodes.up(size), nodes.up(size * (state == 1))
    label = np.where(main == 0, OUT, np.where(main == total, IN, MIXED))
    return label, (total > 0).astype(float)


@functools.lru_cache(1)
def trained() -> Model:
    return Model()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    modest_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        model = held.value
        for b in batches:
            texts = model.main_texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(tidy(run), RESULT)
