"""Queries over the generated pages, for which SQL has no parser, against a small recursive walk."""

import os
from html.parser import HTMLParser

import pytest

from sparkveil import catalog
from sparkveil.operators import selectors
from test_selectors import first

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
GONE = {"script", "style", "noscript", "template", "head", "meta", "link"}
SINGLE = {"br", "meta", "link", "img", "input", "hr"}
PRESSED = {"a", "button", "input", "select", "textarea", "option", "summary", "details", "label"}


class Walk(HTMLParser):
    def __init__(self):
        super().__init__()
        self.top = {"tag": "", "kids": [], "said": []}
        self.path = [self.top]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.path[-1]["tag"] == tag:
            self.path.pop()
        node = {"tag": tag, "kids": [], "said": [], "attrs": dict(attrs)}
        self.path[-1]["kids"].append(node)
        if tag not in SINGLE:
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.path):
            while self.path.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        self.path[-1]["said"].append(data)


def kept(page):
    """(depth, tag, pressed, kept children, text, href) of the nodes that stay, in document order."""
    walk = Walk()
    walk.feed(page or "")
    walk.close()

    def of(node, depth):
        inner = [of(k, depth + 1) for k in node["kids"] if k["tag"] not in GONE]
        own = [i for i in inner if i]
        text = " ".join(" ".join(s for s in node["said"] if s.strip()).split())
        if depth == 1 or node["tag"] in PRESSED or text or own:
            return [(depth, node["tag"], node["tag"] in PRESSED, len(own), text, node["attrs"].get("href")), *(r for i in own for r in i)]
        return []

    return [r for top in walk.top["kids"] if top["tag"] not in GONE for r in of(top, 1)]


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}


def test_flattened_nodes(spark, pages):
    got: dict = {}
    for r in catalog.queries()["html_node_flatten"](spark, DATA).orderBy("page_id", "node_id").collect():
        got.setdefault(r.page_id, []).append((r.depth, r.tag, r.interactive, r.n_children))
    assert got == {p: [r[:4] for r in kept(h)] for p, h in pages.items() if kept(h)}


def test_skeletons(spark, pages):
    flat = {p: [r for r in kept(h) if r[2] or (not r[3] and r[4])] for p, h in pages.items()}
    got = {r.page_id: (r.nodes, r.interactive) for r in catalog.queries()["skeleton_counts"](spark, DATA).collect()}
    assert got == {p: (len(f), sum(r[2] for r in f)) for p, f in flat.items() if f}


def test_compacted_nodes(spark, pages):
    def compact(rows):
        rows = [(d - 1, t, x.strip()[:80], h) for d, t, _, _, x, h in rows if d - 1 <= 5]
        stays = []
        for k in reversed(range(len(rows))):
            depth = rows[k][0]
            below = next((j for j in range(k + 1, len(rows)) if rows[j][0] <= depth), len(rows))
            stays.append(rows[k][1] in ("a", "button", "input", "select", "textarea", "form", "option") or rows[k][1] == "nav" or rows[k][1] in ("li", "ul", "h1") or bool(rows[k][2] or rows[k][3]) or any(stays[len(rows) - 1 - j] for j in range(k + 1, below) if rows[j][0] == depth + 1))
        return [r for r, s in zip(reversed(rows), stays, strict=True) if s]

    want = {p: compact(kept(h)) for p, h in pages.items()}
    got = {r.page_id: (r.nodes, r.depth, r.chars) for r in catalog.queries()["compact_counts"](spark, DATA).collect()}
    assert got == {p: (len(w), max(r[0] for r in w), sum(len(r[2]) for r in w)) for p, w in want.items() if w}


def test_annotations_of_generated_pages(spark, pages):
    got = {(r.page_id, r.ann): r.pre for r in catalog.queries()["annotation_nodes"](spark, DATA).collect()}
    assert got == {(p, k): first(h, s) for p, h in pages.items() for k, s in enumerate(selectors.SELECTORS) if ":not" not in s} | {(p, k): None for p in pages for k, s in enumerate(selectors.SELECTORS) if ":not" in s}
