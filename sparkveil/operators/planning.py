"""Targets of actions and recognised text: matching words to elements, boxes to words, labels that hide values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as X
from ..sources import table
from .regions import boxes

def server_box(box: Column) -> Column:
    """A box of four numbers from a list of one to four or more; far off the page it is null (P1e)."""
    filled = F.slice(F.concat(box, F.array_repeat(F.lit(0.0), 4)), 1, 4)
    return F.when((F.size(box) > 0) & (F.element_at(filled, 1) >= -100) & (F.element_at(filled, 2) >= -100), filled)


def normalised(box: Column, width: Column, height: Column) -> Column:
    """Coordinates in [0, 1], four places, half to even; boxes that already are stay."""
    by = F.array(width, height, width, height)
    return F.when(F.exists(box, lambda v: v > 1), F.transform(box, lambda v, k: F.bround(v / F.element_at(by, (k + 1).cast("int")), 4))).otherwise(box)


#: Where an action's target may be named, in the order in which it is looked for, and how it is shown.
_SHOWN = (
    ("target_selector", "{}"), ("selector", "{}"), ("element_id", "#{}"), ("target_element_id", "#{}"), ("element_type", "<{}>"), ("target", "{}"),
    ("target_type", "<{}>"), ("secret_key", "vault:{}"), ("secret_alias", "vault:{}"),
)


def shown_label(actions: DataFrame) -> Column:
    """A target's name for a status line, from whichever columns there are; typed text never shows."""
    has = lambda c: c in actions.columns
    given = []
    for c, form in _SHOWN:
        if has(c):
            before, after = form.split("{}")
            given.append(F.concat(F.lit(before), F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(after)))
    if has("url"):
        url = F.nullif(F.col("url"), F.lit(""))
        path = F.try_parse_url(url, F.lit("PATH"))
        given += [F.concat(F.try_parse_url(url, F.lit("HOST")), F.when(path.isin("/", ""), F.lit("")).otherwise(F.coalesce(path, F.lit("")))), url]
    if has("x") and has("y"):
        given.append(F.concat(F.lit("("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")")))
    if has("delta_y"):
        given.append(F.concat(F.lit("deltaY: "), F.col("delta_y").cast("string")))
    if has("target_bbox"):
        given.append(F.concat(F.lit("["), F.array_join(F.slice(F.transform("target_bbox", lambda v: v.cast("string")), 1, 4), ","), F.lit("]")))
    return F.coalesce(*given, F.lit(""))


_LABEL_ROWS = "label_id long, target_selector string, target_element_id string, secret_key string, url string, x long, y long, delta_y long, target_bbox array<long>, text string"
LABELS = (("#go", "e1", None, None, 1, 2, None, None, "typed"), ("", "e1", "k", None, None, None, None, None, None), (None, None, "k", "https://a.b/c", None, None, None, None, None), (None, None, None, "https://a.b/c?d=e", 1, 2, None, None, None), (None, None, None, "https://a.b/", None, None, None, None, None), (None, None, None, None, 3, 4, 5, None, "typed"), (None, None, None, None, None, None, -5, [1], None), (None, None, None, None, None, None, None, [1, 2, 3, 4, 5], None), (None,) * 8 + ("typed",))


def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown target of an action for each order: one of the sampled kinds about the order's customer."""
    kinds = spark.createDataFrame([(k, *r) for k, r in enumerate(LABELS)], _LABEL_ROWS).withColumnRenamed("label_id", "kind")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("label_id"), F.col("o_custkey").cast("long").alias("cust"))
    rows = own.join(F.broadcast(kinds), F.col("label_id") % len(LABELS) == F.col("kind"))
    named = {c: F.when(F.col(c) != "", F.concat(c, F.col("cust").cast("string"))).otherwise(F.col(c)) for c in ("target_selector", "target_element_id", "secret_key", "url")}
    rows = rows.withColumns(named | {c: F.when(F.col(c).isNotNull(), F.col("cust")) for c in ("x", "delta_y")})
    rows = rows.withColumn("target_bbox", F.transform("target_bbox", lambda v, k: F.when(k == 0, F.col("cust")).otherwise(v)))
    return rows.select("label_id", shown_label(rows).alias("label"))


def element_texts(actions: DataFrame, elements: DataFrame, near: int = 10) -> DataFrame:
    """(action_id, texts): labels of all elements that an action's id, selector or place points to.

    Ids and selectors join by equality; places by a grid cell and its neighbours.
    """
    e = elements.select("page", "element_id", "selector", "label", F.col("x").alias("ex"), F.col("y").alias("ey"))
    a = actions.select("action_id", "page", "target_element_id", "target_selector", F.col("x").alias("ax"), F.col("y").alias("ay"))
    by_id = a.join(e, (a.page == e.page) & (a.target_element_id == e.element_id)).select("action_id", "element_id", "label")
    by_selector = a.join(e, (a.page == e.page) & (a.target_selector == e.selector)).select("action_id", "element_id", "label")
    around = a.withColumn("cx", F.explode(F.sequence(F.floor((F.col("ax") - near) / 32), F.floor((F.col("ax") + near) / 32)))).withColumn("cell_y", F.explode(F.sequence(F.floor((F.col("ay") - near) / 32), F.floor((F.col("ay") + near) / 32))))
    placed = e.withColumn("cx", F.floor(F.col("ex") / 32)).withColumn("cell_y", F.floor(F.col("ey") / 32))
    by_place = around.join(placed, ["page", "cx", "cell_y"]).where((F.abs(F.col("ax") - F.col("ex")) < near) & (F.abs(F.col("ay") - F.col("ey")) < near)).select("action_id", "element_id", "label")
    every = by_id.unionAll(by_selector).unionAll(by_place).distinct()
    return every.groupBy("action_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("element_id", "label"))), lambda s: s.label).alias("texts"))


def elements_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements derived from boxes: labelled by their category and source."""
    return boxes(spark, sf_dir).select("page", F.concat(F.lit("e"), F.col("ord")).alias("element_id"), F.concat(F.lit("#"), "category", F.lit("-"), "ord").alias("selector"), F.concat("category", F.lit(" "), "source").alias("label"), "x", "y", "ord")


def action_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements_of(spark, sf_dir)
    actions = rows.where("ord = 1").select(F.col("page").alias("action_id"), "page", F.lit("e2").alias("target_element_id"), F.lit("#card-3").alias("target_selector"), "x", "y")
    return element_texts(actions, rows).select("action_id", F.array_join("texts", "|").alias("texts"))


def fallback_target(tasks: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, element_id): the first element in order whose label holds any word of the task."""
    words = F.filter(F.split(F.lower("task"), r"\s+"), lambda w: w != "")
    met = tasks.select("page", words.alias("words")).join(elements, "page").where(F.exists("words", lambda w: F.contains(F.lower(F.col("label")), w)))
    return met.groupBy("page").agg(F.min_by("element_id", "ord").alias("element_id"))


def query_words(query: Column) -> Column:
    """Words of three letters or more that can name a target."""
    return F.filter(F.split(F.lower(query), "[^a-zA-Z0-9_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*P.TARGET_STOP_WORDS))


def find_targets(queries: DataFrame, ui: DataFrame, dom: DataFrame) -> DataFrame:
    """The element that each query means (J14): (query_id, source, element_id, selector, action_type, x, y, w, h).

    ``queries``: query_id, page, query.  ``ui``: page, ord, element_id, label, x, y, w, h.  ``dom``: page, ord, id, name, tag, type, text,
    placeholder, aria_label, title, selector, x, y, w, h.  Boxes may be null; elements that cannot be aimed at do not count.
    Sources in order: UI elements by words that are no verbs, by any word, DOM nodes alike, a search field; the first in document order.
    """
    words = query_words(F.col("query"))
    asked = queries.select("query_id", "page", words.alias("words")).withColumn("subjects", F.filter("words", lambda w: ~w.isin(*P.TARGET_VERBS))).where(F.size("words") > 0)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    held = lambda ws, *cs: F.exists(ws, lambda w: F.greatest(*[F.contains(low(c), w) for c in cs]))
    aim = F.col("x").isNull() | G.on_page(tuple(F.col(c) for c in "xywh"))
    ref = lambda c: F.concat(F.lit("#"), F.nullif(F.col(c), F.lit("")))
    place = [F.col(c).cast("double").alias(c) for c in "xywh"]

    def found(rows: DataFrame, first: int, cs: tuple[str, ...], id_: str, selector: Column, kind: Column) -> DataFrame:
        source = F.when(held("subjects", *cs), first).when(held("words", *cs), first + 1)
        return asked.join(rows.where(aim), "page").withColumn("source", source).where("source is not null").select("query_id", "source", "ord", F.col(id_).alias("element_id"), selector.alias("selector"), kind.alias("action_type"), *place)

    tag = low("tag")
    by_name = F.concat(tag, F.lit("[name='"), F.nullif("name", F.lit("")), F.lit("']"))
    typed = F.when(tag.isin("input", "textarea") & ~low("type").isin("button", "submit", "checkbox", "radio"), "type").otherwise("click")
    text = dom.withColumn("text", F.coalesce(F.nullif("text", F.lit("")), *([F.col("value")] if "value" in dom.columns else [])))
    in_ui = found(ui, 1, ("label", "element_id"), "element_id", ref("element_id"), F.lit("click"))
    in_dom = found(text, 3, ("text", "id", "name", "placeholder"), "id", F.coalesce(F.nullif("selector", F.lit("")), ref("id"), by_name), typed)
    field = tag.isin("input", "textarea") & (F.greatest(*[F.contains(low(c), F.lit("search")) for c in ("id", "name", "placeholder", "aria_label", "title")]) | (low("type") == "search") | low("name").isin("q", "query"))
    fields = asked.join(dom.where(field), "page").select("query_id", F.lit(5).alias("source"), "ord", F.col("id").alias("element_id"), F.coalesce(F.nullif("selector", F.lit("")), ref("id"), F.lit("input[name='q'], input[type='search'], input[aria-label*='Search' i]")).alias("selector"), F.lit("type").alias("action_type"), *[F.when(aim, F.col(c)).cast("double").alias(c) for c in "xywh"])
    every = in_ui.unionByName(in_dom).unionByName(fields)
    columns = [c for c in every.columns if c != "query_id"]
    return every.groupBy("query_id").agg(F.min_by(F.struct(*columns), F.struct("source", "ord")).alias("t")).select("query_id", *[F.col(f"t.{c}").alias(c) for c in columns if c != "ord"])


def _search_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks (one an order), UI elements and DOM nodes of derived pages."""
    every = boxes(spark, sf_dir)
    k = F.col("o_orderkey") % 5
    task = F.when(k == 0, "Click the card and play").when(k == 1, "open the ocr thing").when(k == 2, "find zebra videos").when(k == 3, "search face").otherwise("go to it")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("query_id"), F.col("o_orderkey").cast("long").alias("page"), task.alias("query"))
    ui = every.where("source <> 'ocr'").select("page", "ord", F.concat(F.lit("e"), "ord").alias("element_id"), F.concat("category", F.lit(" Play")).alias("label"), (F.col("x") - F.when(F.col("ord") == 1, 900).otherwise(0)).alias("x"), "y", "w", "h").where("ord % 2 = 1")
    none = [F.lit(None).cast("string").alias(c) for c in ("placeholder", "aria_label", "title")]
    dom = every.select("page", "ord", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("d"), "ord")).alias("id"), F.when(F.col("ord") == 4, "q").otherwise("").alias("name"), F.when(F.col("ord") % 2 == 0, "INPUT").otherwise("p").alias("tag"), F.when(F.col("pct") > 95, "submit").otherwise("text").alias("type"), F.when(F.col("ord") > 1, F.upper("source")).alias("text"), F.when(F.col("ord") == 5, "p.five").alias("selector"), F.lit(None).cast("long").alias("x"), "y", "w", "h", *none)
    return tasks, ui, dom


def target_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_targets(*_search_tables(spark, sf_dir)).select("query_id", F.col("source").cast("long").alias("source"), "element_id", "selector", "action_type", "x")


def target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("page"), F.when(F.col("o_orderkey") % 2 == 0, "Click the card from  nowhere").otherwise("open password face").alias("task"))
    return fallback_target(tasks, elements_of(spark, sf_dir))


_ACTION = "struct<type:string,target_bbox:array<double>,target_selector:string,target_element_id:string,secret_key:string,text:string,url:string,reason:string>"


def enrich_plans(plans: DataFrame, ui: DataFrame, dom: DataFrame) -> DataFrame:
    """Plans with usable targets: (plan_id, actions, task_complete).

    ``plans``: plan_id, page, task, step, task_complete and actions (array of the fields of ``_ACTION``).  A plan that is done at its first step, or that
    gave up, although the task asks for something, becomes an action on what the task means.  Placeholder texts and boxes off the page go; actions without
    a target get the element that their reason, text or task means; of more than two actions one stays, or two that belong together.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    actions = F.coalesce(F.col("actions"), F.array().cast(f"array<{_ACTION}>"))
    rows = plans.withColumn("actions", actions)
    said = F.array_join(F.transform(F.filter("actions", lambda a: a.type == "done"), lambda a: low(a.reason)), " ")
    asks = F.greatest(*[F.contains(F.lower(F.col("task")), F.lit(w)) for w in P.TASK_VERBS])
    gave_up = F.greatest(*[F.contains(said, F.lit(w)) for w in P.GIVEN_UP])
    idle = F.exists("actions", lambda a: a.type == "done") | F.col("task_complete") | (F.size("actions") == 0)
    rows = rows.withColumn("override", asks & ((F.col("step") == 1) | gave_up) & idle)
    typed_words = F.array_join(F.filter(F.split("task", "[^a-zA-Z0-9_]+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*P.TYPED_STOP_WORDS)), " ")

    def tidy(a: Column) -> Column:
        b = a.target_bbox
        aimed = (F.size(b) >= 4) & (F.get(b, 0) >= -500) & (F.get(b, 1) >= -500) & (F.get(b, 2) > 0) & (F.get(b, 3) > 0)
        return a.withField("reason", F.when(~F.lower(F.trim(a.reason)).isin(*P.PLACEHOLDER_REASONS), a.reason)).withField("target_selector", F.when(~F.lower(F.trim(a.target_selector)).isin(*P.PLACEHOLDER_SELECTORS), a.target_selector)).withField("target_bbox", F.when(aimed, b))

    given = lambda c: F.coalesce(c, F.lit("")) != ""
    rows = rows.withColumn("actions", F.transform("actions", tidy))
    # what is looked for: the task itself (pos -1), and for each action what may name its target
    loose = lambda a: given(a.target_selector) & F.contains(F.trim(a.target_selector), F.lit(" ")) & ~a.target_selector.rlike(r"[>+~\[#.]") & a.target_bbox.isNull() & ~given(a.target_element_id)
    lost = lambda a: a.type.isin("click", "type", "hover", "press", "fill_secret") & ~given(a.target_selector) & a.target_bbox.isNull() & ~given(a.target_element_id)
    vague = lambda a: ~given(a.reason) | (F.size(F.filter(F.split(F.trim(a.reason), r"\s+"), lambda w: w != "")) <= 2)
    query = lambda a: F.when(lost(a), F.when(vague(a), F.col("task")).otherwise(a.reason)).when(a.type.isin("click", "type", "hover", "press", "fill_secret") & loose(a), a.target_selector)
    own = F.transform("actions", lambda a, k: F.struct(k.cast("int").alias("pos"), query(a).alias("query")))
    asked = rows.select("plan_id", "page", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.when(F.col("override"), F.col("task")).alias("query"))), own)).alias("q")).select(F.struct("plan_id", "q.pos").alias("query_id"), "page", "q.query").where("query is not null")
    hits = find_targets(asked, ui, dom).select("query_id.plan_id", F.col("query_id.pos").alias("pos"), F.struct("element_id", "selector", "action_type", F.when(F.col("x").isNotNull(), F.array(*"xywh")).alias("bbox")).alias("hit"))
    hits = hits.groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "hit"))).alias("hits"))
    rows = rows.join(hits, "plan_id", "left")
    hit = lambda pos: F.try_element_at(F.col("hits"), pos)
    none = F.lit(None).cast("string")

    def filled(a: Column, k: Column) -> Column:
        h = hit(k.cast("int"))
        became = (a.type == "click") & (h.action_type == "type")
        new = a.withField("target_bbox", F.coalesce(h.bbox, a.target_bbox)).withField("target_element_id", F.coalesce(h.element_id, a.target_element_id)).withField("target_selector", F.coalesce(h.selector, a.target_selector))
        retyped = new.withField("type", F.when(became, "type").otherwise(a.type)).withField("text", F.when(became & ~given(a.text), typed_words).otherwise(a.text))
        return F.when(h.isNull(), a).when(lost(a), retyped).otherwise(new)

    done = hit(F.lit(-1))
    taken = F.struct(done.action_type.alias("type"), done.bbox.alias("target_bbox"), done.selector.alias("target_selector"), done.element_id.alias("target_element_id"), none.alias("secret_key"), F.when(done.action_type == "type", typed_words).alias("text"), none.alias("url"), F.concat(F.lit("Interact with target matching task '"), F.col("task"), F.lit("'")).alias("reason"))
    overridden = F.col("override") & done.isNotNull()
    out = F.when(overridden, F.array(taken)).otherwise(F.transform("actions", filled))
    rows = rows.select("plan_id", out.alias("actions"), (F.col("task_complete") & ~F.coalesce(overridden, F.lit(False))).alias("task_complete"))
    first, second = F.get("actions", 0), F.get("actions", 1)
    pair = first.type.isin("type", "fill_secret") | second.type.isin("press", "submit", "wait", "fill_secret")
    return rows.withColumn("actions", F.when(F.size("actions") > 2, F.slice("actions", 1, F.when(pair, 2).otherwise(1))).otherwise(F.col("actions")))


def _act(type_: str, **fields) -> tuple:
    return (type_, *[fields.get(c) for c in ("target_bbox", "target_selector", "target_element_id", "secret_key", "text", "url", "reason")])


PLANS = (
    ("Search for blue lamps", 1, True, [_act("done", reason="finished")]), ("Search for blue lamps", 2, True, [_act("done", reason="finished")]), ("Open settings", 3, False, [_act("done", reason="Cannot go on")]),
    ("Do it", 1, False, [_act("click", target_selector="#btn", reason="press the Save button now")]), ("Do it", 1, False, [_act("click", target_bbox=[-600.0, 0.0, 5.0, 5.0], reason="none")]), ("Do it", 1, False, [_act("click", target_selector="blue settings link")]),
    ("Do it", 1, False, [_act("type", text="a", target_element_id="x"), _act("click", target_element_id="y"), _act("click", target_element_id="z")]), ("Do it", 1, False, [_act("click", target_element_id="y"), _act("wait"), _act("wait")]), ("Do it", 1, False, [_act("click", target_element_id="y")] * 3),
    ("find my lost umbrella", 4, False, [_act("click", reason="unauthorized")]),
)


def plan_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of one of the sampled kinds for each order, on a page of its own with two recognised elements and two fields."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("page"), F.col("o_custkey").cast("string").alias("cust"))
    kinds = spark.createDataFrame([(k, *p) for k, p in enumerate(PLANS)], f"kind long, task string, step int, task_complete boolean, actions array<{_ACTION}>")
    rows = pages.join(F.broadcast(kinds), F.col("page") % len(PLANS) == F.col("kind")).withColumn("plan_id", F.col("page"))
    own = lambda text: F.concat(F.lit(text), "cust")
    none = F.lit(None).cast("string")
    element = lambda k, id_, label, *box: F.struct(F.lit(k).cast("long").alias("ord"), id_.alias("element_id"), F.lit(label).alias("label"), *[F.lit(float(v)).alias(c) for v, c in zip(box, "xywh", strict=True)])
    ui = pages.select("page", F.inline(F.array(element(1, own("s"), "Settings", 10, 20, 30, 40), element(2, own("t"), "Save", -900, 0, 5, 5))))
    names = ("id", "name", "tag", "type", "text", "placeholder", "aria_label", "title", "selector")
    field = lambda k, **given: F.struct(F.lit(k).cast("long").alias("ord"), *[given.get(c, none).alias(c) for c in names])
    dom = pages.select("page", F.inline(F.array(field(1, id=own("sv"), tag=F.lit("button"), text=F.lit("Save button")), field(2, name=F.lit("q"), tag=F.lit("input"), type=F.lit("text"), placeholder=F.lit("look here")))))
    dom = dom.withColumns({c: F.lit(None).cast("double") for c in "xywh"})
    got = enrich_plans(rows, ui, dom)
    show = F.array_join(F.transform("actions", lambda a: F.concat_ws(" ", a.type, F.coalesce(a.target_selector, F.lit("-")), F.coalesce(a.target_element_id, F.lit("-")), F.coalesce(a.text, F.lit("-")), F.coalesce(F.get(a.target_bbox, 0).cast("int").cast("string"), F.lit("-")))), "; ")
    return got.select("plan_id", "task_complete", show.alias("actions"))


def span_boxes(lines: DataFrame) -> DataFrame:
    """Sensitive spans of recognised lines as boxes.

    ``lines``: line_id, text, x, y, w, h, confidence and words (text, x, y, w, h, confidence).
    A span's box is the envelope of the words it overlaps; without words it is its share of the line.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int,x:double,y:double,w:double,h:double,confidence:double>>").alias("out"))
    at = lambda acc, w: F.greatest(F.lit(0), F.instr(F.substr("text", acc.at + 1, F.length("text")), w.text) - 1) + acc.at
    step = lambda acc, w: F.struct((at(acc, w) + F.length(w.text)).cast("int").alias("at"), F.array_append(acc.out, F.struct(at(acc, w).cast("int").alias("first"), (at(acc, w) + F.length(w.text)).cast("int").alias("last"), w.x.alias("x"), w.y.alias("y"), w.w.alias("w"), w.h.alias("h"), w.confidence.alias("confidence"))).alias("out"))
    placed = F.aggregate(F.coalesce("words", F.slice("words", 1, 0)), start, step, lambda acc: acc.out)
    rows = lines.withColumn("placed", placed).withColumn("span", F.explode(X.claimed_spans(F.col("text"))))
    rows = rows.withColumn("hit", F.filter("placed", lambda w: (w.first < F.col("span.end")) & (F.col("span.start") < w.last)))
    some = F.size("hit") > 0
    low = lambda c: F.array_min(F.transform("hit", lambda v: v[c]))
    high = lambda c, s: F.array_max(F.transform("hit", lambda v: v[c] + v[s]))
    share = F.col("w") / F.length("text")
    mean = F.aggregate("hit", F.lit(0.0), lambda acc, v: acc + v.confidence) / F.size("hit")
    return rows.select(
        "line_id", F.col("span.category").alias("category"), F.col("span.text").alias("found"),
        G.half_up(F.when(some, low("x")).otherwise(F.col("x") + share * F.col("span.start"))).cast("long").alias("x"), G.half_up(F.when(some, low("y")).otherwise(F.col("y"))).cast("long").alias("y"),
        G.half_up(F.when(some, high("x", "w") - low("x")).otherwise(share * F.length("span.text"))).cast("long").alias("w"), G.half_up(F.when(some, high("y", "h") - low("y")).otherwise(F.col("h"))).cast("long").alias("h"),
        F.when(some, mean).otherwise(F.col("confidence")).alias("confidence"),
    )


LINES = (("Billing Card: 4111 2222 3333 4444 Approved", ((165, "4111"), (210, "2222"), (255, "3333"), (300, "4444"))), ("mail a@b.co now", ()), ("nothing", ()))
_KIND = "line_id long, text string, x double, y double, w double, h double, confidence double, words array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"


def ocr_span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive spans of a recognised line for each order: one of the sampled lines, at the order's own height on the page."""
    kinds = spark.createDataFrame([(k, t, 10.0, 100.0, 400.0, 30.0, 0.9, [(w, float(x), 100.0, 40.0, 30.0, 0.95) for x, w in words]) for k, (t, words) in enumerate(LINES)], _KIND.replace("line_id", "kind"))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("line_id"), (F.col("o_custkey") % 50).cast("double").alias("down"))
    rows = own.join(F.broadcast(kinds), F.col("line_id") % len(LINES) == F.col("kind"))
    return span_boxes(rows.withColumn("y", F.col("y") + F.col("down")).withColumn("words", F.transform("words", lambda w: w.withField("y", w.y + F.col("down")))))


from .regions import _BOX  # noqa: E402

_EL = _BOX + ", el AS (SELECT page, 'e' || ord AS element_id, '#' || category || '-' || ord AS selector, category || ' ' || source AS label, x, y, ord FROM b)"
QUERIES = {f.__name__: f for f in (action_elements, target_match, ocr_span_boxes, target_labels, target_search, plan_enrichment)}
ORACLE = {
    "action_elements": f"""WITH {_EL} SELECT a.page AS action_id, string_agg(e.label, '|' ORDER BY e.element_id) AS texts FROM el a JOIN el e ON a.page = e.page
        WHERE a.ord = 1 AND (e.element_id = 'e2' OR e.selector = '#card-3' OR (abs(a.x - e.x) < 10 AND abs(a.y - e.y) < 10)) GROUP BY a.page""",
    "target_match": f"""WITH {_EL}, k AS (SELECT el.page, element_id, row_number() OVER (PARTITION BY el.page ORDER BY ord) AS k FROM el JOIN orders ON o_orderkey = el.page
        WHERE CASE WHEN el.page % 2 = 0 THEN regexp_matches(label, 'click|the|card|from|nowhere') ELSE regexp_matches(label, 'open|password|face') END) SELECT page, element_id FROM k WHERE k = 1""",
    "ocr_span_boxes": """SELECT CAST(o_orderkey AS BIGINT) AS line_id, category, found, CAST(x AS BIGINT) AS x, CAST(100 + o_custkey % 50 AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(30 AS BIGINT) AS h, CAST(confidence AS DOUBLE) AS confidence
        FROM orders JOIN (VALUES (0, 'card', '4111 2222 3333 4444', 165, 175, 0.95), (1, 'email', 'a@b.co', 143, 160, 0.9)) t(kind, category, found, x, w, confidence) ON o_orderkey % 3 = kind""",
    "target_labels": """SELECT CAST(o_orderkey AS BIGINT) AS label_id, CASE o_orderkey % 9 WHEN 0 THEN '#go' || o_custkey WHEN 1 THEN '#e1' || o_custkey WHEN 2 THEN 'vault:k' || o_custkey WHEN 3 THEN 'a.b/c' WHEN 4 THEN 'a.b/' || o_custkey
        WHEN 5 THEN '(' || o_custkey || ', 4)' WHEN 6 THEN 'deltaY: ' || o_custkey WHEN 7 THEN '[' || o_custkey || ',2,3,4]' ELSE '' END AS label FROM orders""",
    "target_search": f"""WITH {_BOX}, q AS (SELECT o_orderkey AS query_id, o_orderkey % 5 AS k FROM orders), w AS (SELECT query_id, ['card', 'ocr,thing', 'zebra,videos', 'face', ''][k + 1] AS s, ['click,card,play', 'open,ocr,thing', 'find,zebra,videos', 'search,face', ''][k + 1] AS a FROM q),
        v AS (SELECT query_id, string_split(s, ',') AS s, string_split(a, ',') AS a FROM w WHERE a <> ''),
        u AS (SELECT page, ord, 'e' || ord AS element_id, '#e' || ord AS selector, 'click' AS action_type, lower(category) || ' play' AS t, 'e' || ord AS t2, x - CASE WHEN ord = 1 THEN 900 ELSE 0 END AS x, 1 AS base FROM b WHERE source <> 'ocr' AND ord % 2 = 1 AND ord > 1),
        d AS (SELECT page, ord, CASE WHEN ord % 3 = 0 THEN 'd' || ord END AS element_id, CASE WHEN ord = 5 THEN 'p.five' WHEN ord % 3 = 0 THEN '#d' || ord WHEN ord = 4 THEN 'input[name=''q'']' END AS selector, CASE WHEN ord % 2 = 0 AND pct <= 95 THEN 'type' ELSE 'click' END AS action_type,
            CASE WHEN ord > 1 THEN source ELSE '' END AS t, CASE WHEN ord % 3 = 0 THEN 'd' || ord ELSE '' END AS t2, NULL AS x, 3 AS base FROM b),
        e AS (SELECT * FROM u UNION ALL SELECT * FROM d), m AS (SELECT query_id, e.*, len(list_filter(s, lambda w: contains(t, w) OR contains(t2, w))) > 0 AS hs, len(list_filter(a, lambda w: contains(t, w) OR contains(t2, w))) > 0 AS ha FROM v JOIN e ON page = query_id),
        f AS (SELECT query_id, ord, element_id, selector, action_type, x, CASE WHEN hs THEN base ELSE base + 1 END AS source FROM m WHERE hs OR ha
            UNION ALL SELECT query_id, ord, NULL, 'input[name=''q''], input[type=''search''], input[aria-label*=''Search'' i]', 'type', NULL, 5 FROM v JOIN b ON page = query_id WHERE ord = 4),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, ord) AS k FROM f)
        SELECT query_id, CAST(source AS BIGINT) AS source, element_id, selector, action_type, CAST(x AS DOUBLE) AS x FROM k WHERE k = 1""",
    "plan_enrichment": """SELECT CAST(o_orderkey AS BIGINT) AS plan_id, o_orderkey % 10 IN (1) AS task_complete, CASE o_orderkey % 10 WHEN 0 THEN 'type input[name=''q''], input[type=''search''], input[aria-label*=''Search'' i] - for blue lamps -' WHEN 1 THEN 'done - - - -' WHEN 2 THEN 'click #s' || o_custkey || ' s' || o_custkey || ' - 10' WHEN 3 THEN 'click #sv' || o_custkey || ' sv' || o_custkey || ' - -' WHEN 4 THEN 'click - - - -' WHEN 5 THEN 'click #s' || o_custkey || ' s' || o_custkey || ' - 10' WHEN 6 THEN 'type - x a -; click - y - -' WHEN 7 THEN 'click - y - -; wait - - - -' WHEN 8 THEN 'click - y - -' WHEN 9 THEN 'type input[name=''q''], input[type=''search''], input[aria-label*=''Search'' i] - lost umbrella -' END AS actions FROM orders""",
}
