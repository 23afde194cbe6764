"""HTML extraction by a tree-structured graphical model over the DOM.

Every element has a label, content or not.  Its features give a potential, and a
table over the labels of parent and child ties the tree together.  Sum-product
messages up and down the tree yield each element's marginal; the weights are
trained on labelled pages by the gradient of their likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.llm.dom import Page, blocks_of, parse
from leadbook.llm.labelled_pages import PAGES

TRAINING_ROUNDS = 600
LEARNING_RATE = 0.5
SHRINK = 0.001

# Words of class, id and role that sites use.
NAMES = {
    "good": "article content post entry story main body text prose",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc skip",
    "side": "sidebar aside widget related recommended promoted popular trending",
    "foot": "footer foot copyright legal colophon",
    "head": "header masthead topbar logo",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo banner",
    "notice": "cookie cookies consent notice alert gdpr privacy popup modal overlay dialog paywall",
    "comment": "comment comments reply replies discussion disqus respond response responses",
    "share": "share sharing social follow tweet facebook",
    "form": "form login signup subscribe subscription newsletter search contact",
}
_NAME_OF = {word: kind for kind, words in NAMES.items() for word in words.split()}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MEMO: dict[tuple, tuple[str, ...]] = {}


def _named(attributes: dict[str, str]) -> tuple[str, ...]:
    """Kinds of names that an element carries."""
    if not attributes:
        return ()
    key = tuple(sorted((k, v) for k, v in attributes.items() if k != "data-main"))
    if key not in _MEMO:
        if len(_MEMO) > 10_000:
            _MEMO.clear()
        words = _PARTS.findall(" ".join(attributes.get(k, "") for k in ("class", "id", "role")))
        kinds = {_NAME_OF[w.lower()] for w in words if w.lower() in _NAME_OF}
        style = attributes.get("style", "").replace(" ", "")
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
            kinds.add("hidden")
        _MEMO[key] = tuple(sorted(kinds))
    return _MEMO[key]


def features(page: Page) -> list[tuple[str, ...]]:
    """Names of the features of every node."""
    nodes = page.nodes
    words, links = [n.words for n in nodes], [n.link_words for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        words[nodes[i].parent] += words[i]
        links[nodes[i].parent] += links[i]
    inside = [False] * len(nodes)
    out = []
    for i, n in enumerate(nodes):
        named = _named(n.attributes)
        own = "own0" if not n.words else "own1" if n.words < 6 else "own2" if n.words < 21 else "own3"
        found = [f"tag:{n.tag}", own]
        found += [f"name:{k}" for k in named]
        if words[i]:
            found.append("links" if 2 * links[i] > words[i] else "prose")
        if n.sentences:
            found.append("sentence")
        if n.words and 2 * n.words > words[0]:
            found.append("most")
        if i:
            above = nodes[n.parent]
            found += [f"in:{k}" for k in _named(above.attributes) if k != "good"]
            inside[i] = inside[n.parent] or above.tag in ("article", "main")
            if inside[i]:
                found.append("in-article")
                if n.tag in ("header", "h1", "h2", "section", "footer"):
                    found.append(f"in-article:{n.tag}")
        out.append(tuple(found))
    return out


def _sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


class ContentModel:
    """Weights of the node features for label 1, and of the label pairs (parent, child)."""

    def __init__(self, weights: dict[str, float] | None = None, pairs: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)):
        self.weights, self.pairs = dict(weights or {}), list(pairs)

    def marginals(self, page: Page, found: list[tuple[str, ...]], with_pairs: bool = False):
        """P(content) of every node; with_pairs also the expected uses of each label pair."""
        nodes, w = page.nodes, self.weights
        p00, p01, p10, p11 = self.pairs
        n = len(nodes)
        up0, up1 = [0.0] * n, [sum(w.get(f, 0.0) for f in fs) for fs in found]  # belief below and at a node
        to0, to1 = [0.0] * n, [0.0] * n  # message to the parent's label 0 and 1
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            to0[i], to1[i] = _sum(p00 + a, p01 + b), _sum(p10 + a, p11 + b)
            parent = nodes[i].parent
            up0[parent] += to0[i]
            up1[parent] += to1[i]
        down0, down1 = [0.0] * n, [0.0] * n
        uses = [0.0, 0.0, 0.0, 0.0]
        content = [0.0] * n
        for i in range(n):
            if i:
                parent = nodes[i].parent
                a, b = up0[parent] + down0[parent] - to0[i], up1[parent] + down1[parent] - to1[i]
                down0[i], down1[i] = _sum(p00 + a, p10 + b), _sum(p01 + a, p11 + b)
                if with_pairs:
                    joint = [a + p00 + up0[i], a + p01 + up1[i], b + p10 + up0[i], b + p11 + up1[i]]
                    top = max(joint)
                    parts = [exp(j - top) for j in joint]
                    uses = [u + p / sum(parts) for u, p in zip(uses, parts)]
            odds = up0[i] + down0[i] - up1[i] - down1[i]
            content[i] = 1 / (1 + exp(odds)) if odds < 700 else 0.0
        return (content, uses) if with_pairs else content

    def extract(self, html: str | None) -> str:
        """The main text: blocks of the elements whose marginal is above one half."""
        page = parse(html)
        return blocks_of(page, [p > 0.5 for p in self.marginals(page, features(page))])


def labels(page: Page) -> list[int]:
    out: list[int] = []
    for n in page.nodes:
        mark = n.attributes.get("data-main")
        out.append(int(mark) if mark is not None else out[n.parent] if n.parent >= 0 else 0)
    return out


def train(pages: tuple[str, ...] = PAGES, rounds: int = TRAINING_ROUNDS) -> ContentModel:
    """Gradient ascent on the likelihood of the labels: observed less expected feature counts."""
    model = ContentModel()
    read = [(p := parse(html), features(p), labels(p)) for html in pages]
    observed: dict[str, float] = {}
    seen = [0.0] * 4
    for page, found, truth in read:
        for i, fs in enumerate(found):
            for f in fs:
                observed[f] = observed.get(f, 0.0) + truth[i]
            if i:
                seen[2 * truth[page.nodes[i].parent] + truth[i]] += 1
    for step in range(rounds):
        expected, used = dict.fromkeys(observed, 0.0), [0.0] * 4
        for page, found, _ in read:
            content, uses = model.marginals(page, found, with_pairs=True)
            used = [a + b for a, b in zip(used, uses)]
            for p, fs in zip(content, found):
                for f in fs:
                    expected[f] += p
        rate = LEARNING_RATE / (1 + 2 * log(1 + step / 10))
        for f, n in observed.items():
            old = model.weights.get(f, 0.0)
            model.weights[f] = old + rate * ((n - expected[f]) / len(read) - SHRINK * old)
        model.pairs = [old + rate * ((n - u) / len(read) - SHRINK * old) for old, n, u in zip(model.pairs, seen, used)]
    return model


def extract_pages(pages: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars (its code points) of every page.

    A null html is empty.  Any text is read as far as it goes; nothing is cut or dropped by
    size.  Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    fitted = model or train()
    weights = pages.sparkSession.sparkContext.broadcast((fitted.weights, tuple(fitted.pairs)))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ContentModel(*weights.value)
        for batch in batches:
            texts = [own.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
