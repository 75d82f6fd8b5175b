"""Regions on a page: spatial joins, clusters, suppression, best match of nodes.

Boxes that can meet share a grid cell: a box is listed in each ``CELL``-sided cell it
covers, pairs are found by an equality join on page and cell, and a pair is kept only in the
first cell that both cover, so no pair is made twice and no page is compared with itself whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as X
from ..plans import greedy, scratch
from ..plans.components import connected_components
from ..sources import table

CELL = 64
IOU, CONTAINED = 0.3, 0.8


def rank_of(category: Column, order: tuple[str, ...]) -> Column:
    """Place of a category in an order of priority; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, order)), category)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def xywh(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions derived from order lines: a page an order, one box a line, numbered within the page."""
    line = table(spark, sf_dir, "lineitem")
    category = F.when(F.col("l_returnflag") == "R", "password").when(F.col("l_returnflag") == "A", "email").when(F.col("l_linestatus") == "O", "card").otherwise("phone")
    source = F.when(F.col("l_linenumber") % 3 == 0, "ocr").when(F.col("l_linenumber") % 3 == 1, "dom").otherwise("face")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"))
    return line.select(
        F.col("l_orderkey").cast("long").alias("page"), number.cast("long").alias("ord"), (F.col("l_partkey") % 100).cast("long").alias("x"), (F.col("l_suppkey") % 100).cast("long").alias("y"),
        (F.col("l_quantity").cast("long") + 10).alias("w"), (F.col("l_linenumber") * 7 + 10).cast("long").alias("h"), category.alias("category"), source.alias("source"), F.floor((1 - F.col("l_discount")) * 100 + 0.5).cast("long").alias("pct"),
    )


def cells(frame: DataFrame, grow: int = 0, cell: int = CELL) -> DataFrame:
    """One row a grid cell that a box, grown on all sides, covers: adds cx and cy."""
    def reach(low: Column, size: Column) -> Column:
        return F.sequence(F.floor((low - grow) / cell), F.floor((low + size + grow) / cell))

    wide = frame.withColumn("cx", F.explode(reach(F.col("x"), F.col("w"))))
    return wide.withColumn("cy", F.explode(reach(F.col("y"), F.col("h"))))


#: A cell of more boxes is cut finer, in halves of its sides, as long as its pieces are no smaller than its boxes are on average.
DENSE, HALVINGS = 64, 4


def leaves(crowded: DataFrame, cell: int) -> DataFrame:
    """One row for each leaf that a box covers in its cell; ``step`` is the leaf's side, cx and cy count leaves.

    All boxes of a cell see the same number of boxes (n) and the same mean side, so they agree on how it is cut.
    """
    wanted, possible = F.ceil(F.log2(F.col("n") / DENSE) / 2), F.floor(F.log2(cell / F.greatest("side", F.lit(1))))
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.least(wanted, possible, F.lit(HALVINGS)))).cast("int")
    rows = crowded.withColumn("parts", parts).withColumn("step", cell / F.col("parts"))

    def reach(low: Column, size: Column, at: Column) -> Column:
        return F.sequence(F.greatest(F.floor(low / F.col("step")), at * F.col("parts")), F.least(F.floor((low + size) / F.col("step")), (at + 1) * F.col("parts") - 1))

    rows = rows.withColumn("cx", F.explode(reach(F.col("x"), F.col("w"), F.col("cx"))))
    return rows.withColumn("cy", F.explode(reach(F.col("y"), F.col("h"), F.col("cy"))))


def pairs(frame: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs a, b (a.ord < b.ord) of a page's boxes that overlap, each once, and some that are only near.

    Boxes meet in cells, those of crowded cells in leaves of them; a pair counts where the corner lies at which its overlap begins.
    """
    own = Window.partitionBy("page", "cx", "cy")
    listed = cells(frame.select("page", "ord", *"xywh"), 0, cell).withColumn("n", F.count("*").over(own)).withColumn("side", F.avg(F.greatest(F.least("w", F.lit(cell)), F.least("h", F.lit(cell)))).over(own))

    def met(rows: DataFrame, keys: list[str], step: Column) -> DataFrame:
        left, right = (rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("ord", *"xywh")]) for side in "ab")
        both = left.join(right, keys).where("a_ord < b_ord")
        first = (F.col("cx") == F.floor(F.greatest("a_x", "b_x") / step)) & (F.col("cy") == F.floor(F.greatest("a_y", "b_y") / step))
        return both.where(first).select("page", *[f"{side}_{c}" for side in "ab" for c in ("ord", *"xywh")])

    plain = met(listed.where(F.col("n") <= DENSE), ["page", "cx", "cy"], F.lit(cell))
    return plain.unionAll(met(leaves(listed.where(F.col("n") > DENSE), cell), ["page", "step", "cx", "cy"], F.col("step")))


def merge_edges(frame: DataFrame) -> DataFrame:
    a, b = xywh("a_"), xywh("b_")
    return pairs(frame.where("w > 0 and h > 0")).where((G.iou(a, b) >= IOU) | (G.containment(a, b) >= CONTAINED))


def usable(regions: DataFrame) -> DataFrame:
    """Drop degenerate boxes and what came from the vision model (F8)."""
    return regions.where((F.col("w") > 0) & (F.col("h") > 0) & ~F.array_contains(F.split("source", r"\+"), "vision") & (F.col("category") != "ui_element"))


def bbox_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = xywh("a_"), xywh("b_")
    rounded = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return pairs(boxes(spark, sf_dir)).where(G.overlap(a, b) > 0).select("page", "a_ord", "b_ord", G.overlap(a, b).cast("long").alias("inter"), rounded(G.iou(a, b)).alias("iou"), rounded(G.containment(a, b)).alias("containment"))


def region_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_edges(boxes(spark, sf_dir)).select("page", "a_ord", "b_ord")


#: Pages of at most so many edges are settled in one task, page after page; larger ones by star contractions.
PAGE_EDGES = 200_000


def _page_roots(batches):
    """Edges (page, a_ord, b_ord) sorted by page -> (page, ord, root): the smallest ord that each box of a page reaches."""
    page, parent = None, {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def done():
        own = sorted(parent)
        return [page] * len(own), own, [top(x) for x in own]

    def rows(out):
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["page", "ord", "root"])

    for batch in batches:
        out = ([], [], [])
        for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("page", "a_ord", "b_ord")), strict=True):
            if p != page:
                for c, v in zip(out, done(), strict=True):
                    c += v
                page, parent = p, {}
            x, y = top(parent.setdefault(a, a) if a not in parent else a), top(parent.setdefault(b, b) if b not in parent else b)
            parent[max(x, y)] = min(x, y)
        yield rows(out)
    yield rows(done())


def clusters(frame: DataFrame) -> DataFrame:
    """The frame with ``root``: the smallest ord of each box's cluster."""
    edges, _ = scratch.write(merge_edges(frame).select("page", "a_ord", "b_ord"))
    large = edges.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > PAGE_EDGES).select("page")
    small, roots = edges, None
    if not large.isEmpty():
        node = lambda c: F.struct(F.col("page"), F.col(c).alias("ord"))
        small = edges.join(large, "page", "left_anti")
        found = connected_components(edges.join(large, "page", "left_semi").select(node("a_ord").alias("a"), node("b_ord").alias("b")))
        roots = found.select("node.page", "node.ord", F.col("component.ord").alias("root"))
    local = small.repartition("page").sortWithinPartitions("page").mapInArrow(_page_roots, "page long, ord long, root long")
    roots = local if roots is None else local.unionAll(roots)
    return frame.join(roots, ["page", "ord"], "left").withColumn("root", F.coalesce("root", "ord"))


def region_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(boxes(spark, sf_dir)).select("page", "ord", "root")


def combined(strategy: str = "probabilistic") -> Column:
    """Confidence of a cluster from the percentages of its members (A4)."""
    c = F.col("pct") / 100.0
    out = {"probabilistic": 1 - F.product(1 - c), "max": F.max(c), "average": F.avg(c)}[strategy]
    # rounded before, so that the order of the product does not decide a tie
    return F.floor(F.round(out, 8) * 10000 + 0.5) / 10000


def cluster_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each cluster by every strategy (A4)."""
    own = clusters(usable(boxes(spark, sf_dir)))
    return own.groupBy("page", "root").agg(*[combined(s).alias(s) for s in ("probabilistic", "max", "average")], F.count("*").alias("members"))


# The confidence that a detection of each source must have.
LEAST_CONFIDENCE = {"ocr": 0.0, "face": 0.5, "vision": 0.25}


def confident(frame: DataFrame, least: dict[str, float] | None = None, confidence: str = "confidence") -> DataFrame:
    """Detections that their source is sure enough of; a merged one counts by its first source, unknown sources have no threshold."""
    known = F.create_map(*[F.lit(v) for pair in (LEAST_CONFIDENCE | (least or {})).items() for v in pair])
    return frame.where(F.coalesce(F.col(confidence), F.lit(1.0)) >= F.coalesce(F.try_element_at(known, F.get(F.split("source", r"\+"), 0)), F.lit(0.0)))


def confident_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose source is sure enough; OCR must reach 0.3 here."""
    source = F.when(F.col("source") == "dom", "vision+dom").otherwise(F.col("source"))
    rows = boxes(spark, sf_dir).withColumn("source", source).withColumn("confidence", F.when(F.col("ord") != 4, (F.col("pct") - 90) / 10.0))
    return confident(rows, {"ocr": 0.3}).select("page", "ord", "source")


def merge_clusters(frame: DataFrame, strategy: str = "probabilistic") -> DataFrame:
    """One region a cluster: envelope, category of highest priority, sources in order, combined confidence."""
    rank = F.struct(rank_of(F.col("category"), P.MERGE_PRIORITY), F.col("ord"))
    # known sources in their order, then others by name
    sources = F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+"))))
    ordered = F.array_sort(F.transform(sources, lambda s: F.struct(rank_of(s, P.SOURCE_ORDER).alias("k"), s.alias("s"))))
    agg = frame.groupBy("page", "root").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("low"), F.min_by("category", rank).alias("category"),
        F.array_join(F.transform(ordered, lambda t: t.s), "+").alias("source"), combined(strategy).alias("confidence"), F.max("pct").alias("pct"), F.count("*").alias("members"),
    )
    return agg.select("page", F.col("root").alias("ord"), "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("low") - F.col("y")).alias("h"), "category", "source", "confidence", "pct", "members")


def region_cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_clusters(clusters(usable(boxes(spark, sf_dir))), "max").select("page", F.col("ord").alias("root"), "x", "y", "w", "h", "category", "source", "confidence", "members")


def merge_regions(frame: DataFrame, strategy: str = "max", rounds: int = 10) -> DataFrame:
    """Merge until nothing overlaps any more, at most ``rounds`` times (A3)."""
    current, path = scratch.write(usable(frame).select("page", "ord", "x", "y", "w", "h", "category", "source", "pct"))
    n = current.count()
    for _ in range(rounds):
        following, new_path = scratch.write(merge_clusters(clusters(current), strategy).select(*current.columns))
        scratch.drop(frame.sparkSession, path)
        current, path, before = following, new_path, n
        n = current.count()
        if n == before:
            break
    return current


def region_merge_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_regions(boxes(spark, sf_dir))


#: Groups of at most so many boxes are settled as one row; larger ones in rounds over the pairs that overlap.
GROUP_BOXES = 500


def split_by_size(frame: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` rows, and those of larger groups (None if there are none)."""
    large, _ = scratch.write(frame.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*by))
    if large.isEmpty():
        return frame, None
    return frame.join(large, by, "left_anti"), frame.join(large, by, "left_semi")


def nms(frame: DataFrame, least: float = 0.45, by: tuple[str, ...] = ("page",), most: int = GROUP_BOXES) -> DataFrame:
    """Greedy non-maximum suppression: by falling confidence, then ord; a box goes if a kept one overlaps it by more than ``least``."""
    small, large = split_by_size(frame, list(by), most)
    rows = small.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("k"), "ord", "x", "y", "w", "h"))).alias("all"))
    at = lambda s: (s.x, s.y, s.w, s.h)
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: G.iou(at(k), at(b)) > least), acc).otherwise(F.array_append(acc, b)))
    kept = rows.select(*by, F.explode(kept).alias("b")).select(*by, "b.ord", (-F.col("b.k")).alias("pct"))
    if large is None:
        return kept
    own, _ = scratch.write(large.select(F.struct(*by).alias("page"), "ord", *"xywh", "pct"))
    met = pairs(own).where(G.iou(xywh("a_"), xywh("b_")) > least)
    rank = own.select("page", "ord", (-F.col("pct")).alias("k"))
    met = met.join(rank.select("page", F.col("ord").alias("a_ord"), F.col("k").alias("a_k")), ["page", "a_ord"]).join(rank.select("page", F.col("ord").alias("b_ord"), F.col("k").alias("b_k")), ["page", "b_ord"])
    node = lambda c: F.struct("page", F.col(c).alias("ord"))
    first = F.struct("a_k", "a_ord") < F.struct(F.col("b_k").alias("a_k"), F.col("b_ord").alias("a_ord"))
    gone = greedy.suppressed(met.select(F.when(first, node("a_ord")).otherwise(node("b_ord")).alias("hi"), F.when(first, node("b_ord")).otherwise(node("a_ord")).alias("lo")))
    rest = own.join(gone.select("node.page", "node.ord"), ["page", "ord"], "left_anti")
    return kept.unionAll(rest.select(*[F.col("page")[c].alias(c) for c in by], "ord", "pct"))


def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nms(boxes(spark, sf_dir))


def within(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs of a page whose boxes are at most ``distance`` apart; columns a_* and b_*."""
    a = cells(left, distance, 256).select("page", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in left.columns if c != "page"])
    b = cells(right, 0, 256).select("page", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in right.columns if c != "page"])
    near = a.join(b, ["page", "cx", "cy"]).drop("cx", "cy")
    return near.where(G.gap(xywh("a_"), xywh("b_")) <= distance).distinct()


def face_heading_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces (small boxes) and headings (wide boxes) of a page at most 20 apart."""
    every = boxes(spark, sf_dir)
    found = within(every.where("source = 'face'").select("page", "ord", *"xywh"), every.where("w > 40").select("page", "ord", *"xywh"), 20).where("a_ord <> b_ord")
    return found.select("page", F.col("a_ord").alias("face"), F.col("b_ord").alias("heading"), (F.floor(G.gap(xywh("a_"), xywh("b_")) * 10000 + 0.5) / 10000).alias("gap"))


def face_names(faces: DataFrame, headings: DataFrame, distance: int = 160) -> DataFrame:
    """(page, face, heading, name): headings near a face whose text can be a person's name."""
    near = within(faces.select("page", "ord", *"xywh"), headings.select("page", "ord", *"xywh", "text"), distance)
    return near.where(X.is_personal_name(F.col("b_text"))).select("page", F.col("a_ord").alias("face"), F.col("b_ord").alias("heading"), F.trim("b_text").alias("name"))


def face_heading_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = boxes(spark, sf_dir)
    text = F.element_at(F.array(*map(F.lit, (" Lena de Ortiz ", "Sign In", "lena ortiz", "Noor Haddad"))), (F.col("ord") % 4 + 1).cast("int"))
    return face_names(every.where("source = 'face'"), every.where("source <> 'face'").withColumn("text", text), 25)


def node_region_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every dom box the best overlapping region of another source: by redaction priority, then confidence."""
    every = boxes(spark, sf_dir)
    nodes = every.where("source = 'dom'").select("page", "ord", *"xywh")
    regions = every.where("source <> 'dom'").select("page", "ord", *"xywh", "category", "pct")
    met = within(nodes, regions, 0).where(G.overlap(xywh("a_"), xywh("b_")) > 0)
    order = F.struct(rank_of(F.col("b_category"), P.REDACTION_PRIORITY), -F.col("b_pct"), F.col("b_ord"))
    best = met.groupBy("page", F.col("a_ord").alias("ord")).agg(F.min_by(F.struct(F.col("b_ord").alias("region"), F.col("b_category").alias("category")), order).alias("m"))
    return nodes.select("page", "ord").join(best, ["page", "ord"], "left").select("page", "ord", "m.region", "m.category", F.when(F.col("m").isNotNull(), X.token_of(F.col("m.category"))).alias("token"))


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts").withColumn("k", F.row_number().over(order)).where("k = 1").select("user_id", "event_type", "event_id")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each region in reading order (top, left) and in order of confidence (L1, L2)."""
    page = Window.partitionBy("page")
    rows = boxes(spark, sf_dir)
    return rows.select("page", "ord", F.row_number().over(page.orderBy("y", "x", "ord")).cast("long").alias("reading"), F.row_number().over(page.orderBy(F.desc("pct"), "ord")).cast("long").alias("by_confidence"))


def region_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all detectors as one table, with the detector's name where a region has none (U1), counted."""
    every = boxes(spark, sf_dir)
    own = [every.where(F.col("source") == s).withColumn("source", F.when(F.col("ord") % 2 == 0, F.col("source"))).withColumn("detector", F.lit(s)) for s in ("dom", "face", "ocr")]
    union = own[0].unionByName(own[1]).unionByName(own[2]).withColumn("source", F.coalesce("source", "detector"))
    return union.groupBy("source", "category").agg(F.count("*").alias("regions"), F.sum("pct").alias("pct"))


_BOX = """b AS (SELECT CAST(l_orderkey AS BIGINT) AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS ord, CAST(l_partkey % 100 AS BIGINT) AS x, CAST(l_suppkey % 100 AS BIGINT) AS y, CAST(trunc(l_quantity) AS BIGINT) + 10 AS w, CAST(l_linenumber * 7 + 10 AS BIGINT) AS h,
    CASE WHEN l_returnflag = 'R' THEN 'password' WHEN l_returnflag = 'A' THEN 'email' WHEN l_linestatus = 'O' THEN 'card' ELSE 'phone' END AS category,
    CASE l_linenumber % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'dom' ELSE 'face' END AS source, CAST(floor((1 - l_discount) * 100 + 0.5) AS BIGINT) AS pct FROM lineitem)"""
_PAIR = _BOX + """, p AS (SELECT a.page, a.ord AS a_ord, b.ord AS b_ord, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h AS sa, b.w * b.h AS sb FROM b a JOIN b ON a.page = b.page AND a.ord < b.ord),
    e AS (SELECT page, a_ord, b_ord FROM p WHERE inter / CAST(sa + sb - inter AS DOUBLE) >= 0.3 OR inter / CAST(least(sa, sb) AS DOUBLE) >= 0.8)"""
_ROOTS = _PAIR.replace("b AS (", "RECURSIVE b AS (", 1) + """, g AS (SELECT page, a_ord AS u, b_ord AS v FROM e UNION SELECT page, b_ord, a_ord FROM e), r AS (SELECT page, ord AS u, ord AS v FROM b UNION SELECT r.page, r.u, g.v FROM r JOIN g ON r.page = g.page AND r.v = g.u),
    c AS (SELECT page, u AS ord, min(v) AS root FROM r GROUP BY page, u)"""
_RANK = lambda e, order: "CASE " + e + " " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(order, 1)) + f" ELSE {len(order) + 1} END"
_GAP = "sqrt(CAST(power(greatest(0, a.x - (c.x + c.w), c.x - (a.x + a.w)), 2) + power(greatest(0, a.y - (c.y + c.h), c.y - (a.y + a.h)), 2) AS DOUBLE))"
QUERIES = {f.__name__: f for f in (cluster_confidence, confident_detections, bbox_pair_metrics, region_merge_edges, region_components, region_cluster_merge, region_merge_fixpoint, nms_boxes, face_heading_distance, face_heading_names, node_region_best, dedupe_keep_first, reading_order, region_union)}


def _rounds(n: int) -> str:
    """SQL of ``n`` rounds of merging: tables m0 to m<n>."""
    out = _BOX + ", m0 AS (SELECT page, ord, x, y, w, h, category, source, pct FROM b WHERE w > 0 AND h > 0)"
    for k in range(n):
        out += f""", p{k} AS (SELECT a.page, a.ord AS a_ord, c.ord AS b_ord, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS i, a.w * a.h AS sa, c.w * c.h AS sb FROM m{k} a JOIN m{k} c ON a.page = c.page AND a.ord < c.ord),
            e{k} AS (SELECT page, a_ord, b_ord FROM p{k} WHERE i / CAST(sa + sb - i AS DOUBLE) >= 0.3 OR i / CAST(least(sa, sb) AS DOUBLE) >= 0.8), g{k} AS (SELECT page, a_ord AS u, b_ord AS v FROM e{k} UNION SELECT page, b_ord, a_ord FROM e{k}),
            r{k} AS (SELECT page, ord AS u, ord AS v FROM m{k} UNION SELECT r.page, r.u, g.v FROM r{k} r JOIN g{k} g ON r.page = g.page AND r.v = g.u), c{k} AS (SELECT page, u AS ord, min(v) AS root FROM r{k} GROUP BY page, u),
            m{k + 1} AS (SELECT page, root AS ord, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, arg_min(category, ({_RANK('category', P.MERGE_PRIORITY)}) * 100 + ord) AS category,
                concat_ws('+', CASE WHEN bool_or(contains(source, 'dom')) THEN 'dom' END, CASE WHEN bool_or(contains(source, 'ocr')) THEN 'ocr' END, CASE WHEN bool_or(contains(source, 'face')) THEN 'face' END) AS source, max(pct) AS pct FROM m{k} JOIN c{k} USING (page, ord) GROUP BY page, root)"""
    return out


_IOU_OF = "greatest(0, least(z.x + z.w, f.x + f.w) - greatest(z.x, f.x)) * greatest(0, least(z.y + z.h, f.y + f.h) - greatest(z.y, f.y))"
ORACLE = {
    "region_merge_fixpoint": f"WITH RECURSIVE {_rounds(10)} SELECT page, ord, x, y, w, h, category, source, pct FROM m10",
    "nms_boxes": f"""WITH RECURSIVE {_BOX}, f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pct DESC, ord) AS k FROM b),
        st AS (SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept, false AS stays FROM (SELECT DISTINCT page FROM f)
            UNION ALL SELECT page, k, CASE WHEN stays THEN list_append(kept, {{'x': x, 'y': y, 'w': w, 'h': h}}) ELSE kept END, stays
            FROM (SELECT f.page, f.k, st.kept, f.x, f.y, f.w, f.h, len(list_filter(st.kept, lambda z: ({_IOU_OF}) / CAST(z.w * z.h + f.w * f.h - ({_IOU_OF}) AS DOUBLE) > 0.45)) = 0 AS stays FROM st JOIN f ON f.page = st.page AND f.k = st.k + 1))
        SELECT f.page, f.ord, f.pct FROM f JOIN st USING (page, k) WHERE stays""",
    "bbox_pair_metrics": f"WITH {_PAIR} SELECT page, a_ord, b_ord, CAST(inter AS BIGINT) AS inter, floor(inter / CAST(sa + sb - inter AS DOUBLE) * 10000 + 0.5) / 10000 AS iou, floor(inter / CAST(least(sa, sb) AS DOUBLE) * 10000 + 0.5) / 10000 AS containment FROM p WHERE inter > 0",
    "region_merge_edges": f"WITH {_PAIR} SELECT * FROM e",
    "cluster_confidence": f"""WITH {_ROOTS}, kk AS (SELECT c.root, b.page, b.pct / 100.0 AS p FROM b JOIN c USING (page, ord)), gg AS (SELECT page, root, round(1 - product(1 - CAST(p AS DOUBLE)), 8) AS a, round(max(CAST(p AS DOUBLE)), 8) AS m, round(avg(CAST(p AS DOUBLE)), 8) AS v, count(*) AS members FROM kk GROUP BY page, root)
        SELECT page, root, floor(a * 10000 + 0.5) / 10000 AS probabilistic, floor(m * 10000 + 0.5) / 10000 AS max, floor(v * 10000 + 0.5) / 10000 AS average, members FROM gg""",
    "confident_detections": f"WITH {_BOX} SELECT page, ord, CASE source WHEN 'dom' THEN 'vision+dom' ELSE source END AS source FROM b WHERE ord = 4 OR (pct - 90) / 10.0 >= CASE source WHEN 'dom' THEN 0.25 WHEN 'face' THEN 0.5 ELSE 0.3 END",
    "region_components": f"WITH {_ROOTS} SELECT * FROM c",
    "region_cluster_merge": f"""WITH {_ROOTS}, k AS (SELECT c.root, b.* FROM b JOIN c USING (page, ord)) SELECT page, root, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
        arg_min(category, ({_RANK('category', P.MERGE_PRIORITY)}) * 100 + ord) AS category, string_agg(DISTINCT source, '+' ORDER BY {_RANK('source', P.SOURCE_ORDER)}) AS source,
        floor(max(pct / 100.0) * 10000 + 0.5) / 10000 AS confidence, count(*) AS members FROM k GROUP BY page, root""".replace("string_agg(DISTINCT source, '+' ORDER BY " + _RANK("source", P.SOURCE_ORDER) + ")", "concat_ws('+', max(source) FILTER (source = 'dom'), max(source) FILTER (source = 'ocr'), max(source) FILTER (source = 'face'))"),
    "face_heading_distance": f"WITH {_BOX} SELECT a.page, a.ord AS face, c.ord AS heading, floor({_GAP} * 10000 + 0.5) / 10000 AS gap FROM b a JOIN b c ON a.page = c.page AND a.ord <> c.ord WHERE a.source = 'face' AND c.w > 40 AND {_GAP} <= 20",
    "face_heading_names": f"WITH {_BOX} SELECT a.page, a.ord AS face, c.ord AS heading, CASE c.ord % 4 WHEN 0 THEN 'Lena de Ortiz' ELSE 'Noor Haddad' END AS name FROM b a JOIN b c ON a.page = c.page WHERE a.source = 'face' AND c.source <> 'face' AND c.ord % 4 IN (0, 3) AND {_GAP} <= 25",
    "node_region_best": f"""WITH {_BOX}, m AS (SELECT a.page, a.ord, c.ord AS region, c.category, row_number() OVER (PARTITION BY a.page, a.ord ORDER BY {_RANK('c.category', P.REDACTION_PRIORITY)}, c.pct DESC, c.ord) AS k
        FROM b a JOIN b c ON a.page = c.page WHERE a.source = 'dom' AND c.source <> 'dom' AND least(a.x + a.w, c.x + c.w) > greatest(a.x, c.x) AND least(a.y + a.h, c.y + c.h) > greatest(a.y, c.y))
        SELECT b.page, b.ord, m.region, m.category, '[REDACTED_' || upper(m.category) || ']' AS token FROM b LEFT JOIN m ON b.page = m.page AND b.ord = m.ord AND m.k = 1 WHERE b.source = 'dom'""",
    "dedupe_keep_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "reading_order": f"WITH {_BOX} SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY y, x, ord) AS reading, row_number() OVER (PARTITION BY page ORDER BY pct DESC, ord) AS by_confidence FROM b",
    "region_union": f"WITH {_BOX} SELECT source, category, count(*) AS regions, CAST(sum(pct) AS BIGINT) AS pct FROM b GROUP BY source, category",
}
