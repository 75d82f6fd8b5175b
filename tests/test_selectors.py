"""Selectors: ends that meet, and resolution against a small recursive matcher."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import selectors as S
from sparkveil.sources import html as H

PAGES = [
    (1, "<html><body><div id=a class='x y'><p>One <b>two</b></p><p title='t x'>Three</p><span lang=en-GB>f</span><p>Four</p></div><ul><li>1<li>2<li class=y>3</ul><input value=' typed ' name='q[0]'></body></html>"),
    (2, "<div><div><div class=x><a href='/in?x=1'>A</a></div></div><a href='/out' data-k>B</a><a href='http://x.org/a.b'>C</a></div><p id='a:b' hidden>D</p><style>p{}</style><script>'<p class=x>'</script>"),
    (3, None), (4, ""), (5, "<p>a<p>b<div><p>c</div><br><br><p class='x x'>d"),
]
SELECTORS = [
    "p", "*", "#a", "#a > p", "#a p b", "div div", "div > div > .x a", ".x", ".x.y", "p.x", "P", "[href]", "a[href^='/in']", "a[href$=\".b\"]", "a[href*=out]", "[title~=x]", "[lang|=en]", "[name='q[0]']", "p:nth-of-type(2)", "p:nth-child(2)", "li:nth-child(2n+1) ", "li:nth-child(odd)", "li:last-child",
    "p + p", "p + span", "p ~ p", "p ~ span ~ p", "span ~ b", "b, span", "nope, li", "#a\\:b", "br + br", "div p:first-of-type", "li:nth-last-child(2)", "span:only-of-type", "body > *", "p:hover", "p >", "> p", "p:nth-child(x)", "a[", "", " ", None, "ul li:nth-child(-n+2)", "div div a, p", "a[data-k]", "a[href^='']", "input", "html body div p", "div a + a", "li:nth-of-type(n+3)",
]


def parse(selector):
    """Alternatives of (combinator, compound) steps, or None where refused."""
    out = []
    for way in re.findall(r"(?:\[(?:\"[^\"]*\"|'[^']*'|[^\]])*\]|\\.|[^,\[\\])+|\[.*", selector):
        text, steps, comb = way.strip(), [], ""
        if not text:
            return None
        while text:
            m = re.match(r"(?:\[(?:\"[^\"]*\"|'[^']*'|[^\]\"'])*\]|:[a-z-]+\([^)]*\)|\\.|[^\s>+~\[\\(])+", text)
            if not m:
                return None
            steps.append((comb, m.group()))
            text = text[m.end() :]
            m = re.match(r"\s*([>+~])\s*|\s+", text)
            if m:
                comb, text = m.group(1) or " ", text[m.end() :]
                if not text:
                    return None
        out.append(steps)
    return out


def fits(node, compound):
    a = {k: v or "" for k, v in node.attrs.items()}
    for t in re.finditer(r"\[\s*([\w-]+)(?:([~|^$*]?=)(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\s*\]|:([a-z-]+)(?:\(([^)]*)\))?|([#.]?)((?:\\.|[\w*-])+)", compound):
        name, op, v1, v2, v3, pseudo, arg, mark, word = t.groups()
        if name:
            v, own = (v1 or v2 or v3 or ""), a.get(name)
            if own is None:
                return False
            if op and not {"=": own == v, "~=": bool(v) and v in own.split(), "|=": own == v or own.startswith(v + "-"), "^=": bool(v) and own.startswith(v), "$=": bool(v) and own.endswith(v), "*=": bool(v) and v in own}[op]:
                return False
        elif pseudo:
            kids = node.parent.children
            alike = [k for k in kids if k.tag == node.tag]
            pool = alike if pseudo.endswith("of-type") else kids
            k, n = next(i for i, x in enumerate(pool) if x is node) + 1, len(pool)
            k = n + 1 - k if "last" in pseudo else k
            if pseudo.startswith("only"):
                ok = n == 1
            elif arg is None:
                ok = k == 1
            else:
                arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
                m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|(\d+)", arg)
                if m[3]:
                    ok = k == int(m[3])
                else:
                    step = int(m[1] + "1") if m[1] in ("", "-", "+") else int(m[1])
                    ok = any(step * j + int(m[2] or 0) == k for j in range(200))
            if not ok:
                return False
        else:
            word = re.sub(r"\\(.)", r"\1", word)
            if mark == "#" and a.get("id") != word or mark == "." and word not in a.get("class", "").split() or not mark and word not in ("*", node.tag) and word.lower() != node.tag:
                return False
    return True


def found(node, steps):
    comb, compound = steps[-1]
    if not fits(node, compound):
        return False
    if len(steps) == 1:
        return True
    kids = node.parent.children
    at = next(i for i, x in enumerate(kids) if x is node)
    up = node.parent
    if comb == ">":
        options = [up]
    elif comb == "+":
        options = kids[at - 1 : at] if at else []
    elif comb == "~":
        options = kids[:at]
    else:
        options = []
        while up is not None:
            options.append(up)
            up = up.parent
    return any(o.parent is not None and found(o, steps[:-1]) for o in options)


def first(page, selector):
    tree = H._Tree()
    tree.feed(page or "")
    tree.close()
    order, stack = [], list(reversed(tree.root.children))
    while stack:
        n = stack.pop()
        order.append(n)
        stack += reversed(n.children)
    ways = parse(selector) if selector and selector.strip() else None
    if ways is None or re.search(r":hover|\(x\)|\[$", selector):
        return None
    return next((k + 1 for k, n in enumerate(order) if any(found(n, w) for w in ways)), None)


def test_resolution_against_a_recursive_matcher(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, html string, tag string")
    rows = [(p, k, s) for p, _ in PAGES for k, s in enumerate(SELECTORS)] + [(99, 0, "p")]
    got = {(r.page_id, r.ann): r for r in S.resolve(spark.createDataFrame(rows, "page_id long, ann int, selector string"), pages).collect()}
    assert len(got) == len(rows)
    source = dict(PAGES)
    for p, k, s in rows:
        assert got[p, k].pre == first(source.get(p), s), (p, s, got[p, k].pre, first(source.get(p), s))
        assert got[p, k].found == (got[p, k].pre is not None)
    at = {s: k for k, s in enumerate(SELECTORS)}
    assert (got[1, at["#a > p"]].text, got[1, at["#a > p"]].tag) == ("One two", "p")
    assert got[1, at["input"]].text == "typed" and got[2, at["#a\\:b"]].text == "D" and got[5, at["div p:first-of-type"]].text == "c"


def test_resolution_on_random_trees(spark):
    rng = random.Random(4)

    def tree(depth):
        tag = rng.choice(["div", "p", "b", "i"])
        return f"<{tag} class='{rng.choice(['x', 'y', 'x y', ''])}'>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 3 if depth else 0))) + f"</{tag}>"

    pages = [(k, "".join(tree(4) for _ in range(3))) for k in range(12)]
    parts = ["div", "b", ".x", ".y", "i.x", "*", "p:nth-child(2)", "b:last-of-type"]
    chosen = list({"".join(x) for _ in range(60) for x in [[rng.choice(parts)] + [rng.choice([" ", " > ", " + ", " ~ "]) + rng.choice(parts) for _ in range(rng.randint(0, 3))]]})
    rows = [(p, k, s) for p, _ in pages for k, s in enumerate(chosen)]
    got = S.resolve(spark.createDataFrame(rows, "page_id long, ann int, selector string"), spark.createDataFrame(pages, "page_id long, html string")).collect()
    source = dict(pages)
    assert all(r.pre == first(source[r.page_id], r.selector) for r in got) and sum(r.found for r in got) > 100


def test_no_annotations(spark):
    none = spark.createDataFrame([], "page_id long, ann int, selector string")
    assert S.resolve(none, spark.createDataFrame([(1, "<p>")], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_same_end_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    one = lambda: "".join(rng.choice(["input", "#email", " > ", "form", ".x", ""]) for _ in range(rng.randint(0, 3)))
    left, right = ([(rng.randint(0, 2), one()) for _ in range(60)] for _ in range(2))
    got = S.same_end(spark.createDataFrame(left, "page long, a string"), spark.createDataFrame(right, "page long, b string"), ["page"]).collect()
    want = {(p, a, b) for p, a in left for q, b in right if p == q and (a.endswith(b) or b.endswith(a))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_plain_selectors(spark):
    row = spark.createDataFrame([("\t #Email\n",), ("  ",)], "s string").select(S.plain(F.col("s"))).collect()
    assert [r[0] for r in row] == ["#email", ""]
