"""Text redaction, spans, leak audits: all JVM-side expressions in one pass over the texts."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans import scratch
from ..sources import table


def count_of(text, category: str):
    found = F.size(F.regexp_extract_all(text, F.lit(dict(P.TEXT_PATTERNS)[category]), F.lit(0))).cast("long")
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(P.MAYBE), found).otherwise(F.lit(0).cast("long"))


def pii_redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redact all documents, then count what was found and what is left, by language and source."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text", X.redact_text(F.col("text")).alias("clean"))
    counts = [F.coalesce(F.sum(count_of(F.col("text"), c)), F.lit(0)).alias(f"n_{c}") for c in ("card", "email", "phone", "ssn")]
    return docs.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.count_if(X.still_has_pii(F.col("text"), F.col("text"))).alias("docs_with_pii"), *counts, F.count_if(X.still_has_pii(F.col("clean"), F.col("text"))).alias("leaked"))


def pii_redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = X.redact_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("clean_chars"))


def pii_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[count_of(F.col("text"), c).alias(f"n_{c}") for c in ("card", "ssn", "email", "phone")])


def pii_spans_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{4}|@"))
    spans = docs.select("doc_id", F.explode(X.claimed_spans(F.col("text"))).alias("s"))
    return spans.select("doc_id", "s.category", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.text")


def pages_html_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose redacted HTML still holds personal data (none may), and what the raw HTML held."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", X.redact_text(F.col("html")).alias("clean"))
    return pages.select("page_id", *[count_of(F.col("html"), c).alias(f"n_{c}") for c in ("card", "email", "phone")], X.still_has_pii(F.col("clean"), F.col("html")).alias("leaked"))


def assert_sanitized(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Fail closed: the job stops at the first payload that still holds a card, an SSN or a clear password."""
    leak = F.col(text).rlike(f"(?:{P.SSN})|(?:{P.CARD})|{P.CLEAR_PASSWORD}")
    return payloads.where(F.when(leak, F.raise_error(F.lit("payload is not sanitized"))).otherwise(F.lit(True)).cast("boolean"))


def payload_error(dom: Column, sources: Column, image_unchanged: Column, passwords: Column) -> Column:
    """Why a payload must not leave; null if it may.

    ``dom``: the serialised tree; ``sources``: sources of the redaction map; ``image_unchanged``: whether the image is the raw one;
    ``passwords``: values of password fields.
    """
    patterns = f"(?:{P.SSN})|(?:{P.CARD})|{P.CLEAR_PASSWORD}"
    return (
        F.when(image_unchanged & (F.size(sources) > 0), "image is unredacted despite sensitive regions")
        .when(dom.rlike(patterns), "sensitive pattern in the tree")
        .when(F.exists(passwords, lambda v: (v != "") & ~F.startswith(v, F.lit("[REDACTED_"))), "password field is not redacted")
        .when(F.exists(sources, lambda s: F.array_contains(F.split(s, r"\+"), "vision")), "redaction map holds vision items")
    )


PAYLOADS = (
    ('{"text": "fine"}', ["dom"], False, ["[REDACTED_PASSWORD]"]), ('{"text": "fine"}', ["dom"], True, []), ('{"text": "fine"}', [], True, [""]), ('{"t": "987-65-4321"}', [], False, []), ('{"t": "4111 1111-1111 1111"}', [], False, []),
    ('{"t": "my plaintext password"}', [], False, []), ('{"Password": "abc"}', [], False, []), ('{"password": "[REDACTED_PASSWORD]"}', [], False, []), ("{}", [], False, ["hunter2"]), ("{}", ["ocr", "dom+vision"], False, []),
)


def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a payload of each document may not leave; its tree holds the document's language beside one of the sampled kinds."""
    kinds = spark.createDataFrame([(k, *p) for k, p in enumerate(PAYLOADS)], "kind long, dom string, sources array<string>, same boolean, passwords array<string>")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(kinds), F.col("doc_id") % len(PAYLOADS) == F.col("kind"))
    dom = F.concat(F.lit('{"lang": "'), "lang", F.lit('", "page": '), "dom", F.lit("}"))
    return rows.select(F.col("doc_id").alias("payload_id"), payload_error(dom, F.col("sources"), F.col("same"), F.col("passwords")).alias("error"))


def outgoing(requests: DataFrame, server_key: bool = True) -> Column:
    """The JSON that leaves: known fields only, boxes of the redaction map without selector and text, no key in server-key mode."""
    region = lambda r: F.struct(F.coalesce(r.bbox, F.array(*[F.lit(0.0)] * 4)).alias("bbox"), F.coalesce(r.category, F.lit("unknown")).alias("category"), F.coalesce(r.source, F.lit("client")).alias("source"), F.coalesce(r.confidence, F.lit(1.0)).alias("confidence"))
    fields = [c for c in ("task", "dom_skeleton", "image_base64", "viewport", "coordinate_space", "image", "timestamp", "nonce", "step", "provider", "model", "base_url", "ui_elements", "session_id", "task_id", *(() if server_key else ("api_key",))) if c in requests.columns]
    return F.to_json(F.struct(*fields, F.transform("redaction_map", region).alias("redaction_map")))


def payload_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each derived page as an outgoing payload: its keys, the keys of its regions, their number and the sum of their confidences."""
    from .regions import boxes

    region = F.struct(F.when(F.col("ord") % 3 != 0, F.array(*[F.col(c).cast("double") for c in "xywh"])).alias("bbox"), "category", F.when(F.col("ord") % 2 == 0, F.col("source")).alias("source"), F.when(F.col("ord") % 4 != 0, F.col("pct") / 100.0).alias("confidence"), F.lit("#secret").alias("selector"), F.lit("Ann").alias("text"))
    rows = boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(region).alias("redaction_map"))
    rows = rows.select("page", "redaction_map", F.lit("pay").alias("task"), F.lit("k").alias("api_key"), F.lit(None).cast("string").alias("provider"), F.lit(1).alias("step"))
    out = rows.select("page", outgoing(rows).alias("j"))
    got = F.from_json("j", "redaction_map array<struct<bbox:array<double>,category:string,source:string,confidence:double>>")["redaction_map"]
    return out.select("page", F.array_join(F.json_object_keys("j"), ",").alias("keys"), F.array_join(F.json_object_keys(F.get_json_object("j", "$.redaction_map[0]")), ",").alias("region_keys"), F.size(got).cast("long").alias("regions"), F.size(F.filter(got, lambda r: r.source == "client")).cast("long").alias("unnamed"), F.floor(F.aggregate(got, F.lit(0.0), lambda acc, r: acc + r.confidence) * 100 + 0.5).cast("long").alias("pct"))


def visual_audit(entities: DataFrame, solid: DataFrame, blurred: DataFrame, mapped: DataFrame, scale: float) -> DataFrame:
    """How each entity is hidden: by a solid box, a blur, or in the redaction map only.

    An entity counts as hidden where its box, as it is or scaled, meets one; the map also by selector.  Columns page, ord, selector, x, y, w, h.
    """
    from ..functions import geometry as G
    from .regions import within, xywh

    keep = ["page", "ord", *"xywh"]
    size = lambda c: F.greatest(F.lit(1).cast("long"), G.half_up(F.col(c) * scale).cast("long"))
    spot = lambda c: G.half_up(F.col(c) * scale).cast("long")
    either = entities.select(*keep).unionAll(entities.select("page", "ord", spot("x").alias("x"), spot("y").alias("y"), size("w").alias("w"), size("h").alias("h")))
    met = lambda other: within(either, other.select(*keep), 0).where(G.overlaps(xywh("a_"), xywh("b_"))).select("page", F.col("a_ord").alias("ord"))
    same = entities.where("selector <> ''").join(mapped.select("page", "selector"), ["page", "selector"], "left_semi").select("page", "ord")
    flag = lambda rows, name: rows.distinct().withColumn("flag", F.lit(name))
    flags = flag(met(solid), "solid").unionAll(flag(met(blurred), "blur")).unionAll(flag(met(mapped).unionAll(same), "map"))
    own = flags.groupBy("page", "ord").agg(*[F.bool_or(F.col("flag") == f).alias(f) for f in ("solid", "blur", "map")])
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    method = F.when(no("solid"), "solid_black_mask").when(no("blur"), "gaussian_blur_or_pixelation").when(no("map"), "redaction_mapped").otherwise("none")
    return entities.join(own, ["page", "ord"], "left").select("page", "ord", no("solid").alias("solid"), no("blur").alias("blur"), no("map").alias("mapped"), method.alias("method"))


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    from .regions import boxes

    every = boxes(spark, sf_dir).withColumn("selector", F.concat(F.lit("#s"), F.col("ord") % 4))
    return every.where("source = 'dom'"), every.where("category = 'card'"), every.where("category = 'email'"), every.where("category = 'phone' and pct > 95")


def entity_visual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_audit(*_audited(spark, sf_dir), 0.75)


def redaction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden and visible entities, selectors that must not be in the map but are (J16), precision, recall and F1."""
    entities, solid, blurred, mapped = _audited(spark, sf_dir)
    seen = visual_audit(entities, solid, blurred, mapped, 0.75)
    innocent = spark.createDataFrame([(s,) for s in INNOCENT], "selector string")
    wrong = innocent.join(mapped.select("selector").distinct(), "selector", "left_semi")
    counts = seen.agg(F.count_if(F.col("method") != "none").alias("tp"), F.count_if(F.col("method") == "none").alias("fn")).crossJoin(wrong.agg(F.count("*").alias("fp")))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    rounded = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return counts.select("tp", "fn", "fp", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(2 * p * r / (p + r)).alias("f1"))


INNOCENT = ("h1", "#s3", "button#save", "#s9")


def payload_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", X.redact_text(F.col("text")).alias("payload"))
    return assert_sanitized(docs).groupBy().agg(F.count("*").alias("payloads"), F.sum(F.length("payload").cast("long")).alias("chars"))


def url_parts_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted urls of the pages, and of literal urls that hold identities."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    literal = spark.createDataFrame([(-k - 1, u) for k, u in enumerate(SLUGS)], "id long, url string")
    return pages.unionAll(literal).select("id", X.redact_url(F.col("url")).alias("url"))


SLUGS = ("https://example.com/in/mira-patel/details", "https://example.com/profile?user=mira", "https://example.org/~mira/cv.pdf", "https://x.org/Users/a.b?Name=c&d=e#f")


def category_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by category over the event types and all known categories."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("category")).distinct()
    known = spark.createDataFrame([(c,) for c in P.TOKEN_OF], "category string")
    return own.unionAll(known).select("category", X.token_of(F.col("category")).alias("token"))


#: Bytes of tokens in one automaton (some sixty times as much in memory), and automata that a pass over the documents carries.
BLOCK_BYTES, BLOCKS = 1 << 20, 4
_automata: dict[str, list] = {}


def _automaton(tokens: list[str]):
    from ahocorasick import Automaton

    made = Automaton()
    for k, t in enumerate(tokens):
        made.add_word(t, k)
    made.make_automaton()
    return made


def _built(key: str, blocks: list) -> list:
    """The automata of a pass, built once in a worker."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = [(b.value, _automaton(b.value)) for b in blocks]
    return _automata[key]


def _dealt(rows, most: int):
    """Lists of tokens of at most ``most`` bytes together (one token may be longer)."""
    block, size = [], 0
    for r in rows:
        n = len(r.token.encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(r.token)
        size += n
    if block:
        yield block


def leak_tokens(tokens: DataFrame, docs: DataFrame, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """(token, docs): in how many documents each raw token occurs; a null token is in none, an empty one in every text.

    All tokens are looked for at once by Aho-Corasick automata over blocks of tokens of a checked size.  The manifest passes
    the driver a block at a time; what exceeds ``blocks`` of them takes a further pass over the documents, so neither the
    driver nor a worker holds more.  A task sends one count a token and batch, not a row a hit.
    """
    spark = tokens.sparkSession
    named = tokens.select("token").where("token <> ''").distinct().orderBy("token")
    texts = docs.select("text").where("text is not null")
    found, path = None, None

    def count(sent: list) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches):
            for batch in batches:
                counts = [Counter() for _ in sent]
                for text in batch.column(0).to_pylist():
                    for own, (_, automaton) in zip(counts, _built(key, sent), strict=True):
                        own.update({k for _, k in automaton.iter(text)})
                rows = [(words[k], n) for own, (words, _) in zip(counts, _built(key, sent), strict=True) for k, n in own.items()]
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["token", "n"])

        return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))

    sent: list = []
    for block in _dealt(named.toLocalIterator(), block_bytes):
        if len(sent) == blocks:
            one, path = scratch.write(count(sent))
            found = one if found is None else found.unionAll(one)
            sent = []
        sent.append(spark.sparkContext.broadcast(block))
    if sent:
        found = count(sent) if found is None else found.unionAll(count(sent))
    empty = tokens.select("token").where("token = ''").distinct().join(texts.agg(F.count("*").alias("n")))
    found = empty if found is None else found.unionAll(empty)
    return tokens.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).cast("long").alias("docs"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, token): listed tokens, and the long words of the benchmark items as ones that must not get out."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]{7,})"), F.lit(1))).alias("token")).distinct()
    listed = spark.createDataFrame([("listed", t) for t in LEAK_TOKENS], "kind string, token string")
    return listed.unionAll(words.select(F.lit("benchmark"), "token"))


def leak_token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = manifest(spark, sf_dir)
    found = leak_tokens(own.select("token").distinct(), table(spark, sf_dir, "documents"))
    return own.join(found, "token").select("kind", "token", "docs", (F.col("docs") > 0).alias("leaked"))


def leak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of leaked raw tokens, in percent, by kind and of all (kind null)."""
    counts = leak_token_audit(spark, sf_dir).rollup("kind").agg(F.count("*").alias("tokens"), F.count_if("leaked").alias("leaked"))
    return counts.withColumn("leak_rate", F.floor(F.col("leaked") / F.col("tokens") * 1000000 + 0.5) / 10000)


LEAK_TOKENS = ("the", "secret", "AKIA", "987-65-4321", "License")

_REDACT = "text"
for _c in ("card", "ssn", "email", "phone"):
    _REDACT = f"regexp_replace({_REDACT}, '{P.SQL_PATTERNS[_c]}', '{P.TOKENS[_c]}', 'g')"
_SLUG = lambda e: f"regexp_replace(regexp_replace(regexp_replace({e}, '{P.USER_PATH}', '\\1[REDACTED_NAME]', 'g'), '{P.TILDE_PATH}', '\\1[REDACTED_NAME]', 'g'), '{P.USER_QUERY}', '\\1[REDACTED_NAME]', 'g')"
_CLEAN = _SLUG(_REDACT)
_HAS = lambda e: "(" + " OR ".join(f"regexp_matches({e}, '{P.SQL_PATTERNS[c]}')" for c in P.SQL_PATTERNS) + ")"
_N = lambda e, c: f"len(regexp_extract_all({e}, '{P.SQL_PATTERNS[c]}'))"

QUERIES = {f.__name__: f for f in (pii_redaction_audit, pii_redacted_text, pii_category_counts, pii_spans_claimed, pages_html_leak, payload_fail_closed, url_parts_slug, category_tokens, leak_token_audit, leak_rate, payload_errors, payload_projection, entity_visual_audit, redaction_quality)}


def clean_sql(e: str) -> str:
    """SQL of redact_text over an expression."""
    return _CLEAN.replace("regexp_replace(text,", f"regexp_replace({e},")


from .regions import _BOX  # noqa: E402

_LEAKS = f"""m AS (SELECT 'listed' AS kind, t AS token FROM (VALUES {', '.join(f"('{t}')" for t in LEAK_TOKENS)}) v(t) UNION ALL SELECT DISTINCT 'benchmark', unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{7,}}')) FROM benchmark),
    g AS (SELECT kind, token, count(d.doc_id) AS docs, count(d.doc_id) > 0 AS leaked FROM m LEFT JOIN documents d ON contains(d.text, m.token) GROUP BY kind, token)"""
_ENT = _BOX + """, s AS (SELECT *, '#s' || ord % 4 AS selector FROM b), z AS (SELECT *, floor(x * 0.75 + 0.5) AS x2, floor(y * 0.75 + 0.5) AS y2, greatest(1, floor(w * 0.75 + 0.5)) AS w2, greatest(1, floor(h * 0.75 + 0.5)) AS h2 FROM s WHERE source = 'dom'),
    o AS (SELECT z.page, z.ord, s.category, s.pct, z.selector AS zs, s.selector AS ss, (least(z.x + z.w, s.x + s.w) > greatest(z.x, s.x) AND least(z.y + z.h, s.y + s.h) > greatest(z.y, s.y)) OR (least(x2 + w2, s.x + s.w) > greatest(x2, s.x) AND least(y2 + h2, s.y + s.h) > greatest(y2, s.y)) AS hit FROM z JOIN s ON z.page = s.page),
    v AS (SELECT page, ord, bool_or(hit AND category = 'card') AS solid, bool_or(hit AND category = 'email') AS blur, bool_or(category = 'phone' AND pct > 95 AND (hit OR zs = ss)) AS mapped FROM o GROUP BY page, ord),
    w AS (SELECT *, CASE WHEN solid THEN 'solid_black_mask' WHEN blur THEN 'gaussian_blur_or_pixelation' WHEN mapped THEN 'redaction_mapped' ELSE 'none' END AS method FROM v)"""
ORACLE = {
    "payload_errors": "SELECT doc_id AS payload_id, error FROM documents JOIN (VALUES (0, NULL), (1, 'image is unredacted despite sensitive regions'), (2, NULL), (3, 'sensitive pattern in the tree'), (4, 'sensitive pattern in the tree'), (5, 'sensitive pattern in the tree'), (6, 'sensitive pattern in the tree'), (7, NULL), (8, 'password field is not redacted'), (9, 'redaction map holds vision items')) v(kind, error) ON doc_id % 10 = kind",
    "payload_projection": f"WITH {_BOX} SELECT page, 'task,step,redaction_map' AS keys, 'bbox,category,source,confidence' AS region_keys, count(*) AS regions, count(*) FILTER (ord % 2 <> 0) AS unnamed, CAST(sum(CASE WHEN ord % 4 <> 0 THEN pct ELSE 100 END) AS BIGINT) AS pct FROM b GROUP BY page",
    "entity_visual_audit": f"WITH {_ENT} SELECT * FROM w",
    "redaction_quality": f"""WITH {_ENT}, c AS (SELECT count(*) FILTER (method <> 'none') AS tp, count(*) FILTER (method = 'none') AS fn, (SELECT count(DISTINCT selector) FROM s WHERE category = 'phone' AND pct > 95 AND selector IN {INNOCENT}) AS fp FROM w),
        r AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS r FROM c) SELECT tp, fn, fp, floor(p * 10000 + 0.5) / 10000 AS precision, floor(r * 10000 + 0.5) / 10000 AS recall, floor(2 * p * r / (p + r) * 10000 + 0.5) / 10000 AS f1 FROM r""",
    "pii_redaction_audit": f"""SELECT lang, source, count(*) AS docs, count(*) FILTER ({_HAS('text')}) AS docs_with_pii,
        {', '.join(f"CAST(coalesce(sum({_N('text', c)}), 0) AS BIGINT) AS n_{c}" for c in ('card', 'email', 'phone', 'ssn'))}, count(*) FILTER ({_HAS('clean')}) AS leaked
        FROM (SELECT *, {_CLEAN} AS clean FROM documents) GROUP BY lang, source""",
    "pii_redacted_text": f"SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS clean_chars FROM (SELECT doc_id, {_CLEAN} AS clean FROM documents)",
    "pii_category_counts": "SELECT doc_id, " + ", ".join(f"CAST({_N('text', c)} AS BIGINT) AS n_{c}" for c in ("card", "ssn", "email", "phone")) + " FROM documents",
    "pages_html_leak": f"SELECT page_id, {', '.join(f'CAST({_N("html", c)} AS BIGINT) AS n_{c}' for c in ('card', 'email', 'phone'))}, {_HAS(_CLEAN.replace('text', 'html', 1))} AS leaked FROM pages",
    "payload_fail_closed": f"SELECT count(*) AS payloads, CAST(sum(length({_CLEAN})) AS BIGINT) AS chars FROM documents",
    "url_parts_slug": f"SELECT id, {_SLUG('url')} AS url FROM (SELECT page_id AS id, url FROM pages UNION ALL VALUES {', '.join(f'''({-k - 1}, '{u}')''' for k, u in enumerate(SLUGS))})",
    "category_tokens": "WITH m(category, token) AS (VALUES " + ", ".join(f"('{k}', '{P.TOKENS[v]}')" for k, v in P.TOKEN_OF.items()) + ") SELECT a.category, coalesce(m.token, '[REDACTED_PII]') AS token FROM (SELECT DISTINCT event_type AS category FROM events UNION ALL SELECT category FROM m) a LEFT JOIN m ON m.category = lower(a.category)",
    "leak_token_audit": f"WITH {_LEAKS} SELECT * FROM g",
    "leak_rate": f"WITH {_LEAKS}, r AS (SELECT kind, count(*) AS tokens, count(*) FILTER (leaked) AS leaked FROM g GROUP BY ROLLUP (kind)) SELECT *, floor(leaked / CAST(tokens AS DOUBLE) * 1000000 + 0.5) / 10000 AS leak_rate FROM r",
    "pii_spans_claimed": "WITH " + ", ".join(
        f"""{c}_k AS (SELECT doc_id, text, unnest(range(1, len(m) + 1)) AS k, m, p FROM (SELECT doc_id, text, regexp_extract_all(text, '{r}') AS m, regexp_split_to_array(text, '{r}') AS p FROM documents)),
        {c} AS (SELECT doc_id, '{c}' AS category, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s, m[k] AS t FROM {c}_k)"""
        for c, r in (("ssn", P.SQL_PATTERNS["ssn"]), ("card", P.SQL_PATTERNS["card"]), ("email", P.EMAIL), ("phone", P.PHONE_OPEN))
    ) + """, k1 AS (SELECT * FROM ssn), k2 AS (SELECT * FROM k1 UNION ALL SELECT c.* FROM card c WHERE NOT EXISTS (SELECT 1 FROM k1 WHERE k1.doc_id = c.doc_id AND k1.s < c.s + length(c.t) AND c.s < k1.s + length(k1.t))),
        k3 AS (SELECT * FROM k2 UNION ALL SELECT c.* FROM email c WHERE NOT EXISTS (SELECT 1 FROM k2 WHERE k2.doc_id = c.doc_id AND k2.s < c.s + length(c.t) AND c.s < k2.s + length(k2.t))),
        k4 AS (SELECT * FROM k3 UNION ALL SELECT c.* FROM phone c WHERE NOT EXISTS (SELECT 1 FROM k3 WHERE k3.doc_id = c.doc_id AND k3.s < c.s + length(c.t) AND c.s < k3.s + length(k3.t)))
        SELECT doc_id, category, s AS start, s + length(t) AS "end", t AS text FROM k4""",
}
