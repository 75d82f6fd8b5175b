"""HTML pages as node rows: a tree walk in Arrow batches with the standard parser.

One row a kept node, numbered in document order; there is no layout engine, so
boxes are null.  Scripts, styles and the like are skipped, hidden nodes too (by attribute, by display, visibility or
opacity in their style, or inside closed details), and so is what lies deeper than ``MAX_DEPTH``.  A node stays if it is the root, interactive, labelled,
marked, has text of its own, or has a child that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

# Tags without content, void tags, what makes a node interactive.
SKIPPED = frozenset(("script", "style", "noscript", "template", "head", "meta", "link"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INTERACTIVE_TAGS = frozenset(("a", "button", "input", "select", "textarea", "option", "summary", "details", "label"))
INTERACTIVE_ROLES = frozenset(("button", "link", "checkbox", "radio", "textbox", "combobox", "menuitem", "tab", "switch", "option", "searchbox", "slider"))
# Roles implied by tags.
ROLE_OF = {"button": "button", "select": "combobox", "textarea": "textbox", "img": "img", "li": "listitem", "ul": "list", "ol": "list", "nav": "navigation", "main": "main", "form": "form", "table": "table"} | {f"h{k}": "heading" for k in range(1, 7)}
ROLE_OF_INPUT = {"checkbox": "checkbox", "radio": "radio", "button": "button", "submit": "button", "reset": "button", "image": "button"}
MAX_DEPTH = 50
FIELDS = ("tag", "role", "type", "aria_label", "text", "selector", "xpath", "id", "name", "class_name", "autocomplete", "placeholder", "value", "href", "src", "data_pii_type", "rel", "itemprop")


_CLEAR = re.compile(r"(?:^|;)opacity:(?:0(?:\.0*)?|\.0+)(?:;|!|$)")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "depth", "nth", "counts", "hidden", "place", "order")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.parts = tag, attrs, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.counts: dict[str, int] = {}
        self.nth = self.place = 1
        self.order: list[_Node | str] = []
        style = (attrs.get("style") or "").replace(" ", "").lower()
        self.hidden = tag in SKIPPED or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or _CLEAR.search(style) is not None or bool(parent and (parent.hidden or (parent.tag == "details" and tag != "summary" and "open" not in parent.attrs)))
        if parent:
            self.nth = parent.counts[tag] = parent.counts.get(tag, 0) + 1
            parent.children.append(self)
            self.place = len(parent.children)
            parent.order.append(self)


class _Tree(HTMLParser):
    def __init__(self, keep_text: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.keep_text = keep_text
        self.root = self.at = _Node("#document", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "td", "tr", "option") and self.at.tag == tag:
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        if data.strip():
            self.at.parts.append(data)
        if self.keep_text:
            self.at.order.append(data)


def role_of(tag: str, attrs: dict) -> str | None:
    own = (attrs.get("role") or "").strip().lower()
    if own:
        return own
    if tag == "a":
        return "link" if "href" in attrs else None
    if tag == "input":
        return ROLE_OF_INPUT.get((attrs.get("type") or "text").lower(), "textbox")
    return ROLE_OF.get(tag)


def _inner(node: _Node) -> str:
    return " ".join([*node.parts, *(_inner(c) for c in node.children if not c.hidden and c.depth <= MAX_DEPTH)])


def _text(node: _Node) -> str | None:
    a = node.attrs
    if node.tag in ("input", "textarea"):
        return a.get("value") or a.get("placeholder") or " ".join(node.parts) or None
    if node.tag == "img":
        return a.get("alt") or None
    if node.tag == "select":
        options = [n for c in node.children for n in (c, *c.children) if n.tag == "option"]
        chosen = next((n for n in options if "selected" in n.attrs), options[0] if options else None)
        return " ".join(_inner(chosen).split()) or None if chosen else None
    return " ".join(" ".join(node.parts).split()) or None


def flatten(html: str | None, selectors: bool = True) -> list[dict]:
    """The kept nodes of a page, in document order."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    labels = {}
    every: list[_Node] = []
    stack = list(reversed(tree.root.children))
    while stack:
        node = stack.pop()
        if node.hidden or node.depth > MAX_DEPTH:
            continue
        every.append(node)
        if node.tag == "label" and node.attrs.get("for"):
            labels.setdefault(node.attrs["for"], " ".join(_inner(node).split()))
        stack.extend(reversed(node.children))
    by_id = {n.attrs["id"]: n for n in reversed(every) if n.attrs.get("id")}
    kept: dict[int, dict] = {}
    for node in reversed(every):
        a, role, text = node.attrs, role_of(node.tag, node.attrs), _text(node)
        referred = " ".join(" ".join(_inner(by_id[i]).split()) for i in (a.get("aria-labelledby") or "").split() if i in by_id)
        label = a.get("aria-label") or referred or a.get("title") or a.get("alt") or labels.get(a.get("id")) or None
        interactive = node.tag in INTERACTIVE_TAGS or role in INTERACTIVE_ROLES or "onclick" in a or "tabindex" in a or "contenteditable" in a
        pii = a.get("data-pii-type") or a.get("data-pii")
        children = [c for c in node.children if id(c) in kept]
        if node.depth == 1 or interactive or text or label or pii or children:
            kept[id(node)] = {
                "tag": node.tag, "role": role, "type": a.get("type"), "aria_label": label, "text": text, "id": a.get("id"), "name": a.get("name"), "class_name": a.get("class"), "autocomplete": a.get("autocomplete"),
                "placeholder": a.get("placeholder"), "value": a.get("value"), "href": a.get("href"), "src": a.get("src"), "data_pii_type": pii, "rel": a.get("rel"), "itemprop": a.get("itemprop"), "interactive": interactive, "n_children": len(children), "depth": node.depth, "node": node,
            }
    rows, numbers = [], {}
    for node in every:
        if id(node) in kept:
            row = kept[id(node)]
            numbers[id(node)] = row["node_id"] = len(rows)
            row["parent_id"] = numbers.get(id(node.parent))
            path, n = [], node
            while selectors and n.parent:
                path.append(n)
                n = n.parent
            row["xpath"] = "/" + "/".join(f"{n.tag}[{n.nth}]" for n in reversed(path)) if selectors else None
            css = []
            for n in path:
                if n.attrs.get("id"):
                    css.append("#" + n.attrs["id"])
                    break
                css.append(f"{n.tag}:nth-of-type({n.nth})")
            row["selector"] = " > ".join(reversed(css)) if selectors else None
            rows.append(row)
    return rows


def nodes(pages: DataFrame, selectors: bool = True) -> DataFrame:
    """Node rows of pages(page_id, html)."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = [(p, r) for p, h in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True) for r in flatten(h, selectors)]
                columns = [pa.array([p for p, _ in out], part.schema.field("page_id").type)]
                columns += [pa.array([r[c] for _, r in out], pa.int32()) for c in ("node_id", "parent_id", "depth", "n_children")]
                columns += [pa.array([r["interactive"] for _, r in out], pa.bool_())] + [pa.array([r[c] for _, r in out], pa.string()) for c in FIELDS]
                yield pa.record_batch(columns, names=["page_id", "node_id", "parent_id", "depth", "n_children", "interactive", *FIELDS])

    schema = f"page_id {kind}, node_id int, parent_id int, depth int, n_children int, interactive boolean, " + ", ".join(f"{c} string" for c in FIELDS)
    return pages.select("page_id", "html").mapInArrow(run, schema)


ELEMENT_FIELDS = "pre int, last int, parent int, tag string, id string, classes array<string>, attrs map<string,string>, nth int, nth_of_type int, siblings int, siblings_of_type int, text_from int, text_to int, text string"


def numbered(html: str | None) -> list[dict]:
    """Every element of a page, hidden ones too, as intervals: its number in document order and the last number inside it.

    Number 0 is the document, which holds the page's whole text; an element's text is a piece of it (``text_from``, ``text_to``).
    """
    tree = _Tree(keep_text=True)
    tree.feed(html or "")
    tree.close()
    rows: list[dict] = []
    text: list[str] = []
    chars = 0
    stack: list[tuple[_Node | str | dict, int]] = [(tree.root, 0)]
    while stack:
        item, parent = stack.pop()
        if isinstance(item, str):
            text.append(item)
            chars += len(item)
        elif isinstance(item, dict):  # the end of an element
            item["last"], item["text_to"] = len(rows) - 1, chars
        else:
            siblings, alike = (len(item.parent.children), item.parent.counts[item.tag]) if item.parent else (1, 1)
            a = {k: v or "" for k, v in item.attrs.items()}
            row = {"pre": len(rows), "parent": parent if rows else None, "tag": item.tag, "id": a.get("id"), "classes": a.get("class", "").split(), "attrs": list(a.items()), "nth": item.place, "nth_of_type": item.nth, "siblings": siblings, "siblings_of_type": alike, "text_from": chars, "text": None}
            rows.append(row)
            stack.append((row, 0))
            stack += [(inner, row["pre"]) for inner in reversed(item.order)]
    rows[0]["text"] = "".join(text)
    return rows


def elements(pages: DataFrame) -> DataFrame:
    """Numbered elements of pages(page_id, html)."""
    kind = dict(pages.dtypes)["page_id"]
    fields = f"page_id {kind}, {ELEMENT_FIELDS}"
    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], fields).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = [{"page_id": p, **r} for p, h in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True) for r in numbered(h)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return pages.select("page_id", "html").mapInArrow(run, fields)
