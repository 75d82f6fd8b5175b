"""Columns of any name, and links that only look like links."""

import html.parser

import pytest

from sparkveil.llm import op3_urls, op4_decontamination, op10_simhash

NAMES = ["digest", "own_id", "c_id", "no_id", "c_digest", "row", "fp", "root", "n.a", "a`b", "place", "spans", "n_words"]


@pytest.fixture(scope="module")
def clashing(spark):
    item = " ".join(f"w{k}" for k in range(12))
    texts = ["one two three four five six", "one two three four five six", f"before {item} after these words here and here and here and here it goes on for long", "something else entirely here now", None]
    schema = ", ".join(["doc_id long", "text string", *(f"`{n.replace('`', '``')}` string" for n in NAMES)])
    return spark.createDataFrame([(k, t, *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)], schema), item


def test_keep_first_with_clashing_names(clashing):
    docs, _ = clashing
    kept = op10_simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in docs.collect() if r.doc_id != 1)


@pytest.mark.parametrize("block_chars", [1 << 21, 60])
def test_clean_with_clashing_names(spark, clashing, block_chars):
    docs, item = clashing
    bench = spark.createDataFrame([(1, item), (2, "a benchmark item that is in no document at all, twelve words long"), (3, "and another one that is in no document either, this too long")], "item_id long, text string")
    cleaned = op4_decontamination.clean(docs, bench, block_chars=block_chars)
    assert cleaned.columns == docs.columns
    got = {r.doc_id: r for r in cleaned.collect()}
    assert len(got) == 5 and "w3" not in got[2].text and got[2].text.startswith("before ")
    assert all(got[r.doc_id][n] == r[n] for r in docs.collect() for n in NAMES)


class Judge(html.parser.HTMLParser):
    """Canonical links and refreshes of a page, by the standard parser."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

    def __init__(self):
        super().__init__()
        self.links = []

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.links.append(a.get("href", "").strip())

    handle_startendtag = handle_starttag


BAD = "http://a.com/en/1"
PAGES = [
    (f'<link rel="canonical" href="{BAD}">', "block"), (f"<LINK REL=Canonical HREF={BAD}>", "block"), (f"<link href='{BAD}' rel='x canonical y'/>", "block"), (f'<link rel="icon" rel="canonical" href="{BAD}">', "allow"),
    (f'<!-- <link rel="canonical" href="{BAD}"> -->', "allow"), (f"<script>var s = '<link rel=\"canonical\" href=\"{BAD}\">';</script>", "allow"), (f'<link title="x rel=canonical" rel=icon href="{BAD}">', "allow"), (f'<link data-rel="canonical" href="{BAD}">', "allow"),
    (f'<p title="<link rel=canonical href={BAD}>">t</p>', "allow"), (f"<p don't>x</p><link rel=canonical href='{BAD}'>", "block"), (f"<!-- a --><link rel=canonical href={BAD}><!-- b -->", "block"), (f"<style><!-- </style><link rel=canonical href={BAD}>", "block"),
    (f"<title><link rel=canonical href={BAD}></title>", "allow"), (f"<textarea><link rel=canonical href={BAD}>", "allow"), (f"<script src=x></script ><link rel=canonical href={BAD}>", "block"), (f"<link rel = canonical\nhref = '{BAD}'>", "block"), (f"<linkx rel=canonical href={BAD}>", "allow"),
    (f"<link rel=canonical data-href={BAD}>", "allow"), (f"<link rel=canonical content=' href={BAD}'>", "allow"), (f"< link rel=canonical href={BAD}>", "allow"), (f"<scripted><link rel=canonical href={BAD}></scripted>", "block"), ("<link rel=canonical href=", "allow"), (f"<!--><link rel=canonical href={BAD}>", "block"), ("<p " + "x" * 300_000, "allow"),
    (f"<meta http-equiv=refresh content='0; url={BAD}'>", "block"), (f"<!-- <meta http-equiv=refresh content='0; url={BAD}'> -->", "allow"), (f"<meta name='http-equiv=refresh' content='0; url={BAD}'>", "allow"), (f"<link rel=canonical href={BAD}>" + "<b>'\"" * 50_000, "block"),
]


def test_links_that_are_none(spark):
    rows = [(k, f"http://q{k}.example/x", h) for k, (h, _) in enumerate(PAGES)]
    got = {r.page_id: r.verdict for r in op3_urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: v for k, (_, v) in enumerate(PAGES)}
    for h, v in PAGES:
        if "http-equiv" not in h and "<!-->" not in h and "<scripted>" not in h and len(h) < 10_000 and "textarea" not in h:
            judge = Judge()
            judge.feed(h)
            assert (BAD in judge.links) == (v == "block"), h
