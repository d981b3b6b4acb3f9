"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Each block element (and each inline one with a class or id, and each run of loose text in the body) is a node with
features: its tag, the roles that its class and id tokens hint at, depth, text and link density of its subtree, statistics
of its siblings, the same hints of its ancestors. In some training pages the names are of no known language, so that
structure alone must tell. Boosted trees give log-odds that its subtree holds main text. Decoding picks the best set in which a node is
kept only if its parent is: a subtree is dropped whole if that scores better than keeping its root and the best of its
children. So no ancestor and descendant can contradict each other.

The trees are fitted once per driver on synthetic pages (``training_pages``), whose number is a parameter.

Cases: null and empty html give an empty text; html without main text gives an empty text; unclosed and stray tags are
tolerated; nothing is dropped or cut by length; repeated rows are extracted each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import boosting, dom, training_pages

#: Synthetic pages that the trees are fitted on.
FIT_PAGES = 1200
TREES = 80
TAGS = ("div", "p", "li", "ul", "ol", "h1", "h2", "h3", "table", "tr", "td", "article", "main", "section", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "figure", "dl", "ins", "dialog", "span", dom.LOOSE)
_TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
ROLES = tuple(training_pages.ROLE_NAMES)
_ROLE_OF: dict[str, int] = {}
for _i, _role in enumerate(ROLES):
    for _name in training_pages.ROLE_NAMES[_role]:
        for _part in _name.split("-"):
            _ROLE_OF.setdefault(_part, _i)
#: Tags that hint at a role by themselves.
_TAG_ROLE = {"nav": "nav", "header": "header", "footer": "footer", "aside": "side", "ins": "ad", "form": "form", "dialog": "notice", "main": "main", "article": "main"}
WIDTH = 3 + 2 * len(ROLES) + 15
#: Tags of running text.
_RUNNING = frozenset(("p", "h1", "h2", "h3", "blockquote", dom.LOOSE))


def _roles(node: dom.Node) -> np.ndarray:
    out = np.zeros(len(ROLES))
    for name in node.names:
        role = _ROLE_OF.get(name)
        if role is None and len(name) > 4 and name.endswith("s"):
            role = _ROLE_OF.get(name[:-1])
        if role is not None:
            out[role] = 1
    if node.tag in _TAG_ROLE:
        out[ROLES.index(_TAG_ROLE[node.tag])] += 2
    return out


def features(nodes: list[dom.Node]) -> np.ndarray:
    """One row per node but the root."""
    n = len(nodes)
    index = {id(node): i for i, node in enumerate(nodes)}
    own = np.zeros((n, 5))  # characters, of them in links, signs of sentences, text pieces, links
    for i, node in enumerate(nodes):
        for _, piece, linked in node.texts:
            size = len(piece)
            if size == 1 and piece == " ":
                continue
            own[i, 0] += size
            own[i, 1] += size if linked else 0
            own[i, 2] += piece.count(".") + piece.count(",") + piece.count("?") + piece.count("!")
            own[i, 3] += 1
        own[i, 4] = node.links
    total, count = own.copy(), np.ones(n)
    parent = np.array([index[id(node.parent)] if node.parent else 0 for node in nodes])
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        count[parent[i]] += count[i]
    page = max(total[0, 0], 1)
    out = np.zeros((n, WIDTH))
    above = np.zeros((n, len(ROLES)))
    for i, node in enumerate(nodes):
        roles = _roles(node) if node.names or node.tag in _TAG_ROLE else 0
        row = out[i]
        row[0] = _TAG_INDEX.get(node.tag, len(TAGS))
        row[1] = node.depth
        row[2] = len(node.children)
        row[3 : 3 + len(ROLES)] = roles
        row[3 + len(ROLES) : 3 + 2 * len(ROLES)] = above[parent[i]] if i else 0
        above[i] = np.maximum(above[parent[i]], roles) if i else roles
        k = 3 + 2 * len(ROLES)
        text, linked = total[i, 0], total[i, 1]
        siblings = node.parent.children if node.parent else [node]
        up = max(total[parent[i], 0], 1)
        row[k : k + 8] = (
            np.log1p(text), linked / max(text, 1), total[i, 2] / max(text, 1) * 100, text / count[i], text / page, text / up, len(siblings), count[i],
        )
        row[k + 8] = i / n
        row[k + 9] = total[i, 4] / count[i]
        row[k + 10] = np.log1p(own[i, 0])
        row[k + 11] = total[parent[i], 1] / up
    # sibling statistics: share with the same tag, place among them, and how much of the text they are in is running text
    for node in nodes:
        kids = node.children
        if kids:
            tags: dict[str, int] = {}
            running = 0.0
            for c in kids:
                tags[c.tag] = tags.get(c.tag, 0) + 1
                if c.tag in _RUNNING and not c.names:
                    running += total[index[id(c)], 0] - total[index[id(c)], 1]
            running /= max(total[index[id(node)], 0], 1)
            for place, c in enumerate(kids):
                out[index[id(c)], k + 12] = tags[c.tag] / len(kids)
                out[index[id(c)], k + 13] = place / len(kids)
                out[index[id(c)], k + 14] = running
    return out


def beside(nodes: list[dom.Node], odds: np.ndarray) -> np.ndarray:
    """Odds in which a run of loose text shares those of the unnamed running text next to it."""
    out = odds.copy()
    index = {id(node): i for i, node in enumerate(nodes)}
    kids = nodes[0].children
    for place, node in enumerate(kids):
        if node.tag == dom.LOOSE:
            near = [kids[k] for k in (place - 1, place + 1) if 0 <= k < len(kids)]
            near = [odds[index[id(c)]] for c in near if c.tag in _RUNNING and not c.names and c.tag != dom.LOOSE]
            if near:
                out[index[id(node)]] += sum(near) / len(near)
    return out


def decode(nodes: list[dom.Node], odds: np.ndarray) -> list[bool]:
    """Best consistent choice: ``odds`` are gains for keeping a node; dropping a subtree gains the negative of them all."""
    n = len(nodes)
    index = {id(node): i for i, node in enumerate(nodes)}
    drop, keep = -odds.copy(), odds.copy()
    best_keep = np.zeros(n, dtype=bool)
    for i in range(n - 1, -1, -1):
        best_keep[i] = keep[i] >= drop[i]
        p = nodes[i].parent
        if p is not None:
            j = index[id(p)]
            drop[j] += drop[i]
            keep[j] += max(keep[i], drop[i])
    kept = [True] * n
    for i in range(1, n):
        kept[i] = bool(kept[index[id(nodes[i].parent)]] and best_keep[i])
    return kept


def main_text(nodes: list[dom.Node], kept: list[bool]) -> str:
    """Texts of the kept nodes in page order; where none is kept, the loose text of the body."""
    pieces = [t for node, k in zip(nodes[1:], kept[1:], strict=True) if k for t in node.texts]
    if not any(kept[1:]):
        pieces = [t for node in nodes if node.tag == dom.LOOSE for t in node.texts]
    gaps = [t for node in nodes for t in node.texts if t[1] == " "]
    pieces = sorted({t[0]: t for t in pieces + gaps}.values())
    return dom.clean([t[1] for t in pieces])


def _labels(html: str, nodes: list[dom.Node]) -> np.ndarray:
    """Marks of the training pages: in page order of the start tags; unmarked ones follow their parent."""
    marks = {}
    order = 0
    for m in dom.TAG.finditer(html):
        tag = (m[2] or m[5] or "").lower()
        if not tag or m[1] or m[4] or tag in ("html", "body") or tag in dom.VOID or tag in dom.UNREAD:
            continue
        attributes = m[3] or m[6] or ""
        if tag in dom.INLINE and not dom.name_tokens(attributes):
            continue
        order += 1
        if "data-keep=" in attributes:
            marks[order] = attributes.rpartition("data-keep=")[2][0] == "1"
    index = {id(node): i for i, node in enumerate(nodes)}
    out = np.ones(len(nodes))
    order = 0
    for i in range(1, len(nodes)):
        if nodes[i].tag == dom.LOOSE:
            out[i] = any(training_pages.KEPT in piece for _, piece, _ in nodes[i].texts)
            continue
        order += 1
        out[i] = marks.get(order, out[index[id(nodes[i].parent)]])
    return out


@lru_cache(maxsize=2)
def fitted(count: int = FIT_PAGES) -> boosting.Trees:
    xs, ys = [], []
    for _, html in training_pages.pages(count):
        nodes = dom.parse(html)
        xs.append(features(nodes)[1:])
        ys.append(_labels(html, nodes)[1:])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys), trees=TREES)


def texts(htmls: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main text of each page."""
    out = []
    for k in range(0, len(htmls), 64):
        parsed = [dom.parse(h or "") for h in htmls[k : k + 64]]
        odds = trees.odds(np.concatenate([features(nodes) for nodes in parsed]))
        at = 0
        for nodes in parsed:
            own = beside(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            own[0] = 0
            out.append(main_text(nodes, decode(nodes, own)))
    return out


def _extractor(trees: boosting.Trees):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return extract


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """(page_id, url, text) per row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(_extractor(fitted(fit_pages)), f"page_id {kind}, url string, text string")
