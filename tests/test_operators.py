import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.functions import geometry as G
from sparkveil.functions import images as I
from sparkveil.operators import dom, metrics, plan_text, planning, redaction, regions, rules, state
from sparkveil.sources import corpus, html

BOX = "page long, ord long, x long, y long, w long, h long, category string, source string, pct long"


def test_sensitivity_rules(spark):
    got = {r.node_id: (r.category, r.rule) for r in rules.sample_nodes(spark).withColumn("found", rules.sensitivity()).select("node_id", "found.category", "found.rule").collect()}
    names = [a for _, a in rules._NODES]
    by = lambda **a: got[names.index(a)][0]
    assert by(name="user_ssn") == "ssn" and by(id="cvv") == "card" and by(name="sms_otp") == "otp" and by(name="client_secret") == "password"
    assert all(by(name=n) is None for n in ("shipping_address", "pantry_items", "syntax_highlighter", "first_name"))
    assert got[0] == ("password", "type_password")


def test_geometry(spark):
    row = spark.range(1).select(
        G.box_of_corners(F.lit(10), F.lit(20), F.lit(110), F.lit(70)).alias("b"),
        G.overlap(tuple(map(F.lit, (0, 0, 200, 200))), tuple(map(F.lit, (50, 50, 50, 50)))).alias("i"),
        G.iou(tuple(map(F.lit, (0, 0, 200, 200))), tuple(map(F.lit, (50, 50, 50, 50)))).alias("iou"),
        G.confidence(F.lit(95)).alias("c1"), G.confidence(F.lit(None)).alias("c2"), G.confidence(F.lit(150)).alias("c3"),
    ).first()
    assert tuple(row.b) == (10, 20, 100, 50) and row.i == 2500 and row.iou == 0.0625 and (row.c1, row.c2, row.c3) == (0.95, 0.85, 1.0)


def test_merge(spark):
    frame = spark.createDataFrame([(1, 1, 100, 200, 300, 40, "email", "dom", 100), (1, 2, 105, 208, 180, 24, "email", "ocr", 92), (2, 1, 50, 100, 250, 45, "card", "dom", 100), (2, 2, 60, 110, 140, 25, "password", "ocr", 85), (3, 1, 0, 0, 5, 5, "face", "cv", 70), (3, 2, 90, 90, 5, 5, "face", "vision", 70)], BOX)
    got = {r.page: r for r in regions.merge_regions(frame).collect()}
    assert (got[1].x, got[1].y, got[1].w, got[1].h, got[1].source) == (100, 200, 300, 40, "dom+ocr")
    assert got[2].category == "password" and got[3].ord == 1
    one = regions.merge_clusters(regions.clusters(spark.createDataFrame([(1, 1, 400, 150, 80, 80, "face", "cv", 78), (1, 2, 410, 155, 80, 85, "face", "cv", 82)], BOX))).first()
    assert (one.x, one.y, one.w, one.h, one.confidence) == (400, 150, 90, 90, 0.9604)


def test_nms(spark):
    frame = spark.createDataFrame([(1, 1, 60, 50, 80, 100, "face", "cv", 94), (1, 2, 62, 52, 78, 98, "face", "cv", 88), (1, 3, 59, 49, 82, 102, "face", "cv", 72)], BOX)
    assert [r.ord for r in regions.nms(frame, 0.35).collect()] == [1]


def test_assignment_is_one_to_one(spark):
    kind = "page long, ord long, x long, y long, w long, h long, cls string, pct long"
    truth = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "a", 0)], kind)
    found = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "a", 50), (1, 2, 1, 0, 10, 10, "a", 90), (2, 1, 0, 0, 1, 1, "a", 10)], kind)
    got = {(r.page, r.ord): r.hit for r in metrics.assign(truth, found).collect()}
    assert got == {(1, 1): False, (1, 2): True, (2, 1): False}


def test_latency(spark):
    frame = spark.createDataFrame([("a", 51.2), ("a", 44.2), ("b", None)], "k string, v double")
    row = metrics.latency_exact(frame, "k", "v").first()
    assert (row["count"], row["min"], row["max"], row["mean"], row.p50) == (2, 44.2, 51.2, 47.7, 51.2)


def test_steps_and_nonces(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = spark.createDataFrame([(1, 7, at(0)), (2, 7, at(10)), (3, 7, at(41)), (4, 7, at(71))], "event_id long, user_id long, ts timestamp")
    assert [r.step for r in state.session_steps(events, ttl=30).orderBy("event_id").collect()] == [1, 2, 1, 2]
    assert [r.accepted for r in state.nonce_replay(events, seconds=40).orderBy("event_id").collect()] == [True, False, True, False]


def test_payload_fails_closed(spark):
    frame = spark.createDataFrame([("ok [REDACTED_SSN]",), ("987-65-4321",)], "payload string")
    assert redaction.assert_sanitized(frame.limit(1)).count() == 1
    with pytest.raises(Exception, match="not sanitized"):
        redaction.assert_sanitized(frame).collect()


PAGE = """<html><head><title>Una Brook | Site</title><script type="application/ld+json">{"@graph": [{"@type": "Person", "name": "Pia Roth"}, {"@type": "Article", "author": {"@type": ["Person"], "givenName": "Otto", "familyName": "Lind"}}]}</script>
</head><body><div style="display: none">hidden</div><label for="e">E-mail</label><input id="e" type="email" value="a@b.co"><a rel="author" href="/in/sif-dahl">Sif Dahl</a><div><span></span></div></body></html>"""


def test_html(spark):
    rows = html.flatten(PAGE)
    assert [r["tag"] for r in rows] == ["html", "body", "label", "input", "a"]
    assert rows[3]["aria_label"] == "E-mail" and rows[3]["role"] == "textbox" and rows[3]["selector"] == "#e" and rows[4]["xpath"] == "/html[1]/body[1]/a[1]"
    assert html.flatten(None) == [] and html.flatten("<p") == []
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    assert {r.name for r in dom.identities(pages).collect()} == {"Pia Roth", "Una Brook", "Otto Lind", "Sif Dahl"}
    clean = {r.tag: r for r in dom.redact_nodes(html.nodes(pages)).collect()}
    assert clean["input"].value == "[REDACTED_EMAIL]" and clean["a"].href == "/in/[REDACTED_NAME]"


def test_json_repair():
    assert plan_text.repair('```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert plan_text.repair('x {"a": {"b": 1, "c": "tru') == {"a": {"b": 1}}
    assert plan_text.repair('{"target_bbox": [x, y, w, h] or null}') == {"target_bbox": None}
    assert plan_text.repair("none") is None and plan_text.repair("") is None


def test_corpus_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "pages": [{"id": "01", "name": "Login"}, {"id": "02", "name": "Profile"}]}))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/01.json").write_text(json.dumps({"pageId": "01", "annotations": [{"id": "x", "type": "email"}], "negativeSelectors": ["#n"]}))
    pages = corpus.manifest(spark, str(tmp_path / "m.json"))
    assert [r.id for r in corpus.manifest(spark, str(tmp_path / "m.json"), "prof").collect()] == ["02"]
    assert {r.id: len(r.annotations) for r in corpus.annotations(spark, str(tmp_path / "a"), pages).collect()} == {"01": 1, "02": 0}
    shapes = [json.dumps(v) for v in ({"data": {"lines": [{"text": "a"}]}}, {"lines": [{"text": "b"}]}, [{"text": "c"}], {"text": "d"})]
    assert [r.line.text for r in corpus.ocr_lines(spark.createDataFrame([(s,) for s in shapes], "payload string")).collect()] == list("abcd")


def test_images():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (20, 30, 4)).astype(np.uint8)
    assert (I.decode_png(I.encode_png(image)) == image).all()
    out = I.redact(image, [(5, 5, 10, 10)], "solid")
    assert (out[5:15, 5:15, :3] == 0).all() and (out[:5] == image[:5]).all()
    flat = np.full((9, 9, 4), 7, np.uint8)
    I.box_blur(flat, (0, 0, 9, 9), 3)
    assert (flat == 7).all()
    I.pixelate(image, (0, 0, 8, 8))
    assert (image[0:4, 0:4] == image[0, 0]).all()
    page = np.full((20, 40, 4), 255, np.uint8)
    page[3:6, 5:30, :3] = page[12:15, 8:20, :3] = 0
    assert I.text_lines(page) == [(5, 3, 25, 3), (8, 12, 12, 3)]
    page[3:6, 14:20, :3] = 255  # a gap of six columns is none
    assert I.text_lines(page)[0] == (5, 3, 25, 3)
    page[3:6, 14:23, :3] = 255  # nine are
    assert I.text_lines(page)[:2] == [(5, 3, 9, 3), (23, 3, 7, 3)]
    page[7:9, 5:30, :3] = 0  # two rows are no line
    assert len(I.text_lines(page)) == 3
    assert I.text_lines(255 - page) == I.text_lines(page)  # light on dark
    faint = np.full((20, 40, 4), 250, np.uint8)
    faint[3:9, 5:30, :3] = 220
    assert I.text_lines(faint) == [] and I.text_lines(np.where(faint == 220, 210, faint).astype(np.uint8)) == [(5, 3, 25, 6)]
    assert I.resize(image, 15).shape[:2] == (10, 15) and I.tensor(image, 8).shape == (3, 8, 8)


def test_recognised_spans(spark):
    rows = [(k, t, 10.0, 100.0, 400.0, 30.0, 0.9, [(w, float(x), 100.0, 40.0, 30.0, 0.95) for x, w in words]) for k, (t, words) in enumerate(planning.LINES)]
    got = {r.category: r for r in planning.span_boxes(spark.createDataFrame(rows, planning._KIND)).collect()}
    card = got["card"]
    assert (card.x, card.y, card.w, card.h, card.confidence) == (165, 100, 175, 30, 0.95)
    assert got["email"].x == 10 + round(400 / 15 * 5) and set(got) == {"card", "email"}


def test_server_boxes(spark):
    row = spark.range(1).select(
        planning.server_box(F.array(F.lit(5.0), F.lit(6.0))).alias("two"), planning.server_box(F.array(F.lit(-101.0), F.lit(6.0))).alias("off"),
        planning.normalised(F.array(*map(F.lit, (100.0, 50.0, 20.0, 10.0))), F.lit(1000.0), F.lit(500.0)).alias("n"),
    ).first()
    assert row.two == [5.0, 6.0, 0.0, 0.0] and row.off is None and row.n == [0.1, 0.1, 0.02, 0.02]


@pytest.mark.parametrize(("block_bytes", "blocks"), [(1 << 20, 4), (4_000, 2), (50, 3)])
def test_leak_tokens_of_a_long_manifest(spark, block_bytes, blocks):
    n = 100_000 if block_bytes > 4_000 else 1_500 if block_bytes > 50 else 60
    tokens = spark.createDataFrame([(f"<tok{k}>",) for k in range(n)] + [("absent",), (None,), ("",), ("tok1",), ("é<",)], "token string")
    docs = spark.createDataFrame([(" ".join(f"<tok{k}>" for k in range(n)),), ("<tok7><tok7>é<tok",), (None,), ("",)], "text string").repartition(3)
    got = {r.token: r.docs for r in redaction.leak_tokens(tokens, docs, block_bytes, blocks).collect()}
    assert got == {f"<tok{k}>": 1 + (k == 7) for k in range(n)} | {"absent": 0, None: 0, "": 3, "tok1": 1, "é<": 1}
    assert redaction.leak_tokens(tokens.limit(0), docs).count() == 0


def test_hidden_nodes_and_chosen_options():
    page = "<body><details><summary>More</summary><p>inside</p></details><details open><p>shown</p></details><p style='opacity: 0'>gone</p><p style='opacity:0.5'>faint</p><select><option>a</option><option selected>b c</option></select></body>"
    nodes = html.flatten(page)
    texts = [n["text"] for n in nodes if n["tag"] in ("p", "summary", "select")]
    assert texts == ["More", "shown", "faint", "b c"]


def test_faces_and_ui_proposals():
    image = np.full((60, 60, 4), 255, np.uint8)
    image[10:40, 10:36, :3] = (200, 150, 120)
    for y, x in ((10, 10), (10, 30), (34, 10), (34, 30)):  # round off the corners
        image[y : y + 6, x : x + 6, :3] = 255
    assert I.faces(image) == [(10, 10, 26, 30, 0.82)]
    image[18:24, 14:30, :3] = 0
    assert I.faces(image) == [(10, 10, 26, 30, 0.94)]
    page = np.full((80, 80, 4), 255, np.uint8)
    assert I.ui_proposals(page) == []
    page[21:41, 11:31, :3] = 90
    found = I.ui_proposals(page)
    assert (11, 21, 20, 20, "icon") in [f[:5] for f in found] and all(0.65 <= f[5] <= 0.96 for f in found)


def test_large_areas_stop_at_their_number_of_cells():
    """The extent of an area over the cap follows from the order of steps: up first, then down, left, right."""
    field = I._Field(30, 30)
    assert field.area(10, 10, np.ones((30, 30), bool), 11) == (10, 0, 1, 11, 11)  # up to the border
    assert not field.free[11, 12] and field.free[12, 12]  # beside the column: reached, so taken; further: not
    skin = np.full((200, 200, 4), 255, np.uint8)
    skin[:, :, :3] = (200, 150, 120)
    assert I.faces(skin) == [(0, 0, 149, 200, 0.82)]  # 15,000 cells of a picture that is all skin


def test_centres(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, "xywh", strict=True)])
    cases = [
        ((995, 10, 200, 10), {}, (1023, 15)), ((0.1, 0.1, 0.2, 0.2), {}, (205, 154)), ((100, 100, 20, 20), {"space": "norm1000"}, (113, 84)), ((1200, 10, 0, 0), {"space": "1000"}, (1023, 10)), ((1200, 10, 0, 0), {"space": "norm1000"}, (1229, 8)),
        ((100, 50, 20, 20), {"scale": 0.5}, (220, 120)), ((600, 50, 20, 20), {"scale": 0.5}, (610, 60)), ((1000, 500, 20, 20), {"image_w": 2048, "image_h": 1536}, (505, 255)), ((1000, 500, 20, 20), {"image_w": 1020, "image_h": 770}, (1010, 510)), ((-50, -9, 10, 2), {}, (0, 0)),
    ]
    got = spark.range(1).select(*[G.centre(box(*b), 1024, 768, **o).alias(f"c{k}") for k, (b, o, _) in enumerate(cases)]).first()
    assert [(got[k].x, got[k].y) for k in range(len(cases))] == [want for *_, want in cases]


def test_region_overrides_and_recogniser(spark):
    row = spark.createDataFrame([("input", "tel")], "tag string, type string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("autocomplete", "name", "id", "aria_label", "placeholder", "text", "value", "data_pii_type")], F.lit(0).alias("n_children"))
    assert row.select(rules.sensitivity(overrides={"type_tel": "contact"}).alias("s")).first().s.category == "contact"
    images = spark.createDataFrame([("p1", b"xy"), ("p2", None)], "page_id string, image binary")
    got = corpus.recognised(images, lambda data: [{"text": data.decode(), "confidence": 0.5}]).collect()
    assert [(r.page_id, r.line.text, r.line.confidence) for r in got] == [("p1", "xy", 0.5)]
    assert corpus.markdown(spark.range(300)).count("\n") == 301


def test_large_pages_use_contractions(spark, monkeypatch):
    monkeypatch.setattr(regions, "PAGE_EDGES", 2)
    rows = [(p, k, 10 * k, 0, 14, 10, "email", "dom", 90) for p in (1, 2) for k in range(1, 7 if p == 1 else 3)] + [(3, 1, 0, 0, 5, 5, "email", "dom", 90)]
    frame = spark.createDataFrame(rows, BOX)
    wide = {(r.page, r.ord): r.root for r in regions.clusters(frame.withColumn("w", F.lit(24).cast("long"))).collect()}
    assert all(root == 1 for root in wide.values()) and len(wide) == 9


def test_compaction_of_lists(spark):
    rows = [("p", 10 * k, None, 0, "div", f"t{k}") for k in range(40)] + [("p", 10 * k + 1, 10 * k, 1, "div", "x") for k in (3, 38)]
    got = {r.node_id for r in dom.compact(spark.createDataFrame(rows, "page_id string, node_id int, parent_id int, depth int, tag string, text string")).collect()}
    assert got == {*range(0, 350, 10), 31}


PROFILE = """<html><head><title>Lena Ortiz | Team</title><meta content="Ivo Marin" name="author">
<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Person"], "name": "Noor Haddad", "givenName": "Noor", "familyName": "El Haddad"}, {"@type": "Article", "author": {"@type": "Person", "name": "Tomas Berg"}}]}</script>
<script type="application/ld+json">{broken</script></head><body><a rel="author" href="/u/x">Ada Quist</a><p class="bio p-name">Rui Costa</p><p>Not Marked</p><span itemprop="name">Search</span></body></html>"""


def test_identities_of_a_page(spark):
    pages = spark.createDataFrame([(1, PROFILE), (2, None), (3, "<p>nobody</p>")], "page_id long, html string")
    assert {(r.page_id, r.name) for r in dom.identities(pages).collect()} == {(1, n) for n in ("Lena Ortiz", "Ivo Marin", "Noor Haddad", "Noor El Haddad", "Tomas Berg", "Ada Quist", "Rui Costa")}


def test_page_nodes_by_hand(spark):
    page = '<body><div id="a"><label for="m">Mail</label><input id="m" name="mail" value="x@y.zz"><p></p></div><ul><li>one<li>two</ul><button aria-labelledby="t">Go</button><b id="t">Start</b></body>'
    rows = [(n["tag"], n["role"], n["aria_label"], n["text"], n["interactive"], n["n_children"], n["selector"]) for n in html.flatten(page)]
    assert rows == [
        ("body", None, None, None, False, 4, "body:nth-of-type(1)"), ("div", None, None, None, False, 2, "#a"), ("label", None, None, "Mail", True, 0, "#a > label:nth-of-type(1)"), ("input", "textbox", "Mail", "x@y.zz", True, 0, "#m"),
        ("ul", "list", None, None, False, 2, "body:nth-of-type(1) > ul:nth-of-type(1)"), ("li", "listitem", None, "one", False, 0, "body:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(1)"), ("li", "listitem", None, "two", False, 0, "body:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(2)"),
        ("button", "button", "Start", "Go", True, 0, "body:nth-of-type(1) > button:nth-of-type(1)"), ("b", None, None, "Start", False, 0, "#t"),
    ]
    nodes = html.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert [r.tag for r in dom.flat_skeleton(nodes).orderBy("node_id").collect()] == ["label", "input", "li", "li", "button", "b"]
    clean = {r.node_id: (r.category, r.text, r.value) for r in dom.redact_nodes(nodes).collect()}
    assert clean[3] == ("email", "[REDACTED_EMAIL]", "[REDACTED_EMAIL]") and clean[5] == (None, "one", None)
    kept = {r.tag for r in dom.compact(nodes.withColumn("depth", F.col("depth") - 1)).collect()}
    assert kept == {"body", "div", "label", "input", "ul", "li", "button", "b"}


def test_plans_of_answers(spark):
    """The shapes of answers and their quirks: names that are there but null, empty values, elements, boxes off the page."""
    cases = {
        '{"type": null, "action": "click", "text": "t"}': (["type - t -"], False, 0.9), '{"action": "", "url": "/u"}': (["navigate - /u -"], False, 0.9), '{"actions": [{"text": ""}, {"selector": ""}, "x", 5]}': ([], False, 1.0),
        '{"actions": {"type": "click"}, "confidence": 0.2}': ([], False, 0.2), '{"tag": "BUTTON", "text": "go", "target_element_id": "e"}': (["click #e e -"], False, 0.85), '{"tag": "textarea", "selector": "#t", "text": "go"}': (["type #t go -"], False, 0.85),
        '{"id": "", "target_bbox": [5, 6]}': (["click - - 5,6,0,0"], False, 0.85), '[{"bbox": [1, -200, 3, 4]}, {"secretKey": "k"}, {"type": "Done"}]': (["fill_secret - k -", "Done - - -"], True, 0.9), '{"task_complete": true}': ([], True, 1.0), "5": None, "nothing": None, None: None,
    }
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(cases)], "k int, answer string")
    for r, want in zip(plan_text.plans(rows).orderBy("k").collect(), cases.values(), strict=True):
        shown = None if r.p is None else ([" ".join([a.type, a.target_selector or "-", a.target_element_id or a.secret_key or a.url or a.text or "-", ",".join(str(int(v)) for v in a.target_bbox) if a.target_bbox else "-"]) for a in r.p.actions], r.p.task_complete, r.p.confidence)
        assert shown == want, (r.answer, shown, want)


def test_prompt_against_a_plain_version(spark):
    """Nested trees, escapes, shares, cuts and missing parts, as plain Python writes them."""
    nodes = [(1, 0, None, "DIV", "a", None), (1, 1, 0, "p", None, 'é "q" 𝒳\n'), (1, 2, 1, "b", None, "x"), (1, 3, 0, "i", None, "y"), (2, 0, None, "p", None, "one"), (2, 1, None, "p", None, "two"), (None, 0, None, "p", None, "z")]
    trees = {r.page_id: r.tree for r in plan_text.tree_json(spark.createDataFrame(nodes, "page_id long, node_id long, parent_id long, tag string, id string, text string")).collect()}
    dump = lambda v: json.dumps(v, separators=(",", ":"))
    first = {"tag": "div", "id": "a", "children": [{"tag": "p", "text": 'é "q" 𝒳\n', "children": [{"tag": "b", "text": "x"}]}, {"tag": "i", "text": "y"}]}
    assert trees == {1: dump(first), 2: dump([{"tag": "p", "text": "one"}, {"tag": "p", "text": "two"}]), None: dump({"tag": "p", "text": "z"})}
    element = {"id": "e1", "label": "ü 𝒳", "bbox": [1, 2, 3, 4]}
    rows = [(1, [element] * 25, [("password", [10.0, 20.5, 30.0, 400.0]), (None, [0.25, 0.5, 1.0, 0.0]), ("", None)], trees[1]), (2, [], [], None), (3, [{"label": "l" * 3000}], [("card", [1.0])], "t" * 4001)]
    schema = "k int, elements array<struct<id:string,element_id:string,label:string,category:string,bbox:array<long>,text:string>>, regions array<struct<type:string,bbox:array<double>>>, tree string"
    frame = spark.createDataFrame([(k, [tuple(e.get(f) for f in plan_text.ELEMENT_FIELDS) for e in es], rs, t) for k, es, rs, t in rows], schema)
    got = {r.k: r.p for r in frame.select("k", plan_text.prompt(F.lit("Task"), F.lit(1000), F.lit(500), F.col("elements"), F.col("regions"), F.col("tree")).alias("p")).collect()}
    fence = lambda title, tag, text: f"{title}:\n{plan_text.OPENS}\n<{tag}>\n{text}\n</{tag}>\n{plan_text.CLOSES}\n"
    for k, es, rs, tree in rows:
        parts = ["TASK: Task\n", 'VIEWPORT: {"width": 1000, "height": 500}\n']
        if es:
            text = dump(es[:20])
            parts.append(fence("DETECTED UI ELEMENTS", "untrusted_ui_elements", text if len(text) <= 2500 else text[:2500] + "... [truncated]"))
        if rs:
            lines = [plan_text.REGIONS_HEAD]
            for n, (kind, box) in enumerate(rs, 1):
                line = f'- Region {n}: type="{kind or "sensitive content"}"'
                if box and len(box) >= 4:
                    own = [int(v) if v == int(v) else round(v, 4) for v in box]
                    share = [round(v / by, 4) for v, by in zip(box, (1000, 500, 1000, 500), strict=True)] if any(v > 1 for v in box) else [round(float(v), 4) for v in box]
                    line += f", bbox={own}, normalised coordinates [x, y, w, h]={share} (normalized: {share})"
                lines.append(line)
            parts.append("\n".join([*lines, plan_text.REGIONS_FOOT]) + "\n")
        if tree:
            parts.append(fence("DOM SKELETON", "untrusted_dom_skeleton", tree if len(tree) <= 4000 else tree[:4000] + "... [truncated for context limit]"))
        assert got[k] == "\n".join([*parts, plan_text.ASKS]), k
