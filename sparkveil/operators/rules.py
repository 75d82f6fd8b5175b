"""Ordered rules as CASE expressions: field sensitivity, field refusal, action schema, action risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..sources import table


def _s(name: str) -> Column:
    """A string column that counts missing as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def _found(category, rule) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(category).alias("category"), as_column(rule).alias("rule"))


def sensitivity(form_names: bool = False, check_text: bool = False, overrides: dict[str, str] | None = None) -> Column:
    """struct(category, rule) of the first rule that fits a node; null if none.  ``overrides``: other categories by rule.

    Needs the columns tag, type, autocomplete, name, id, aria_label, placeholder,
    text, value, data_pii_type and n_children of a node table.
    """
    tag, kind, auto = F.lower(_s("tag")), F.lower(_s("type")), _s("autocomplete")
    pii = F.lower(F.trim(_s("data_pii_type")))
    cases: list[tuple[Column, Column]] = [(pii == k, _found(c, f"data_pii_{r}")) for k, (c, r) in P.PII_ATTRIBUTE.items()]
    cases.append((pii != "", _found(pii, F.concat(F.lit("data_pii_"), pii))))
    cases.append((kind == "password", _found("password", "type_password")))
    cases += [(auto.rlike(r), _found("phone" if c == "tel" else c, f"autocomplete_{c}")) for c, r in P.AUTOCOMPLETE]
    cases += [(kind == "email", _found("email", "type_email")), (kind == "tel", _found("phone", "type_tel"))]
    if form_names:
        field = tag.isin("input", "textarea")
        cases.append((field & (_s("name").rlike(P.FORM_NAME) | _s("id").rlike(P.FORM_NAME)), _found("name", "form_name_input")))
        cases.append((field & (_s("placeholder").rlike(P.FORM_NAME_HINT) | _s("aria_label").rlike(P.FORM_NAME_HINT)), _found("name", "form_name_placeholder")))
    every = X.keyword_of(F.concat_ws(" ", *[F.nullif(_s(c), F.lit("")) for c in ("name", "id", "aria_label", "placeholder", "text")]))
    cases.append(((kind == "number") & every.isin("card", "cvv", "cvc", "pan"), _found("card", "type_number_card")))
    cases.append(((kind == "number") & (every == "pin"), _found("pin", "type_number_pin")))
    plain = ~tag.isin(*P.STRUCTURAL_TAGS)
    for column, label in (("name", "name"), ("aria_label", "aria-label"), ("placeholder", "placeholder"), ("id", "id")):
        word = X.keyword_of(_s(column))
        fits = plain & word.isNotNull()
        if column == "id":
            fits = fits & (F.coalesce("n_children", F.lit(0)) == 0)
        cases.append((fits, _found(X.category_of(word), F.concat(F.lit(f"regex_{label}_"), word))))
    content = F.concat_ws(" ", F.nullif(_s("text"), F.lit("")), F.nullif(_s("value"), F.lit("")))
    cases += [(content.rlike(P.CARD), _found("card", "pattern_credit_card")), (content.rlike(P.SSN), _found("ssn", "pattern_ssn")), (content.rlike(P.EMAIL), _found("email", "pattern_email"))]
    if check_text:
        word = X.keyword_of(_s("text"))
        cases.append((word.isNotNull(), _found(X.category_of(word), F.concat(F.lit("regex_text_"), word))))
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    if overrides:
        other = F.try_element_at(F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]), out["rule"])
        out = F.when(out.isNotNull(), F.struct(F.coalesce(other, out["category"]).alias("category"), out["rule"].alias("rule")))
    return out


NODE = "page_id string, node_id int, parent_id int, depth int, ord int, tag string, role string, type string, aria_label string, text string, selector string, xpath string, id string, name string, class_name string, autocomplete string, placeholder string, value string, href string, src string, data_pii_type string, interactive boolean, n_children int, x double, y double, w double, h double"
_NODES = (
    ("input", {"type": "password"}), ("input", {"name": "user_ssn"}), ("input", {"id": "social_security_number"}), ("input", {"placeholder": "Social Security #"}), ("input", {"name": "credit_card"}),
    ("input", {"id": "cvv"}), ("input", {"name": "pan_number"}), ("input", {"name": "sms_otp"}), ("input", {"id": "user_pin"}), ("input", {"name": "client_secret"}), ("input", {"placeholder": "Tax Identification Number (TIN)"}),
    ("input", {"name": "shipping_address"}), ("input", {"name": "billing_company"}), ("input", {"name": "pantry_items"}), ("input", {"name": "syntax_highlighter"}), ("input", {"name": "spinner_value"}), ("input", {"name": "country_code"}), ("input", {"name": "first_name"}),
    ("input", {"autocomplete": "cc-number"}), ("input", {"autocomplete": "billing email"}), ("input", {"autocomplete": "tel-national"}), ("input", {"autocomplete": "given-name"}), ("input", {"type": "email"}), ("input", {"type": "tel"}),
    ("input", {"type": "number", "name": "cardNumber"}), ("input", {"type": "number", "aria_label": "Enter PIN"}), ("span", {"data_pii_type": "financial"}), ("img", {"data_pii_type": "face"}), ("span", {"data_pii_type": "iban"}),
    ("h2", {"name": "card"}), ("div", {"id": "card-wrap", "n_children": 3}), ("p", {"text": "4111 1111 1111 1111"}), ("p", {"text": "ssn 987-65-4321"}), ("p", {"text": "mail me@example.com"}), ("p", {"text": "nothing here"}),
)
_COLUMNS = [c.split(" ")[0] for c in NODE.split(", ")]


def sample_nodes(spark: SparkSession) -> DataFrame:
    rows = [tuple({"page_id": "literal", "node_id": k, "ord": k, "tag": tag, **attributes}.get(c) for c in _COLUMNS) for k, (tag, attributes) in enumerate(_NODES)]
    return spark.createDataFrame(rows, NODE)


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of one of the sampled kinds for each part; its names, texts and hints carry the part's own."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_type", F.col("p_size").cast("string").alias("size"))
    rows = own.join(F.broadcast(sample_nodes(spark).withColumnRenamed("node_id", "kind")), F.col("key") % len(_NODES) == F.col("kind"))
    added = {c: F.concat(c, F.lit("_"), "size") for c in ("name", "id")} | {"text": F.concat("text", F.lit(" "), "p_name"), "placeholder": F.concat("placeholder", F.lit(" "), "p_type")}
    return rows.withColumns(added).withColumnRenamed("key", "node_id")


def sensitivity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_nodes(spark, sf_dir).withColumn("found", sensitivity()).select(F.col("node_id").cast("long").alias("node_id"), "found.category", "found.rule")


def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of part names and of literal identifiers."""
    own = table(spark, sf_dir, "part").select(F.col("p_name").alias("ident")).distinct()
    literal = spark.createDataFrame([(a[k],) for _, a in _NODES for k in ("name", "id", "placeholder") if k in a] + [("userCardNumber",), ("SecurityCode",), ("x_cvc2",)], "ident string")
    word = X.keyword_of(F.col("ident"))
    return own.unionAll(literal).distinct().select("ident", word.alias("keyword"), X.category_of(word).alias("category"))


def name_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    literal = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return own.unionAll(literal).distinct().select("name", X.is_personal_name(F.col("name")).alias("valid"))


NAMES = ("Mira Patel", "John von Neumann", "alan turing", "Terms of Service", "Grace", "Ludwig van der Rohe Jr", "Ana María de la Cruz Soto", "O'Brien Smith", "X1 Y2", "Jo", "Privacy Policy")


def refused(text: Column | None = None, data: tuple[str, ...] = ()) -> Column:
    """Whether an agent must not type into a node (F14); ``data``: which of the data attributes the frame has."""
    out = F.lower(_s("type")) == "password"
    for c in P.REFUSED_AUTOCOMPLETE:
        out = out | F.lower(_s("autocomplete")).contains(c)
    for c in ("name", "id", "placeholder", "aria_label", "class_name"):
        out = out | _s(c).rlike(P.REFUSED_NAME)
    for c, value in P.REFUSED_DATA:
        out = out | (_s(c) == value) if c in data else out
    out = out | _s("value").rlike(P.MARK) | _s("text").rlike(P.MARK)
    return out if text is None else out | F.coalesce(text, F.lit("")).rlike(P.MARK)


def field_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_nodes(spark, sf_dir).select(F.col("node_id").cast("long").alias("node_id"), refused().alias("refused"))


# Kinds of actions, and schemes that are never opened.
ACTION_TYPES = ("click", "type", "input", "scroll", "wait", "navigate", "fill_secret", "done", "submit", "press", "hover")
FORBIDDEN_SCHEMES = ("javascript", "data", "file", "chrome", "chrome-extension")


def url_error(url: Column) -> Column:
    """Why a navigation target is refused; null if it is http or https."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z0-9+.-]+):", 1))
    return (
        F.when(url.isNull() | (url == ""), "navigate action requires a url string")
        .when(u == "", "navigate action requires a non-empty url string")
        .when(scheme.isin(*FORBIDDEN_SCHEMES), F.concat(F.lit('Forbidden URL scheme "'), scheme, F.lit(':": navigation blocked for security')))
        .when((scheme == "") | (scheme.isin("http", "https") & ~u.rlike(r"(?i)^https?:/*[^\s/?#]+[^\s]*$")), F.concat(F.lit('Invalid URL format: "'), u, F.lit('"')))
        .when(~scheme.isin("http", "https"), F.concat(F.lit('Unsupported URL scheme "'), scheme, F.lit(':": only http: and https: are allowed')))
    )


def action_error() -> Column:
    """The first error of an action, null if it is valid (F16)."""
    kind, box = F.lower(_s("type")), F.col("target_bbox")
    bad = F.exists(box, lambda v: v.isNull() | F.isnan(v))
    target = (_s("target_selector") != "") | (_s("target_element_id") != "") | box.isNotNull() | (_s("text") != "") | (_s("reason") != "")
    return (
        F.when(kind == "", "Missing or invalid action type")
        .when(~kind.isin(*ACTION_TYPES), F.concat(F.lit('Unsupported action type: "'), kind, F.lit('"')))
        .when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "Action confidence must be between 0.0 and 1.0")
        .when(_s("target_selector").rlike(r"(?i)<script|javascript:|on[a-z0-9_]+="), "Potentially unsafe script injection in selector")
        .when(F.size(box) < 4, "target_bbox must be an array of at least 4 numbers [x, y, w, h]")
        .when(bad, "target_bbox coordinates must be valid numbers")
        .when(F.exists(F.slice(box, 1, 4), lambda v: v < 0), "target_bbox values cannot be negative")
        .when(kind.isin("click", "fill_secret") & ~target, F.concat(F.lit('Action "'), kind, F.lit('" requires a target locator')))
        .when((kind == "fill_secret") & (_s("secret_key") == ""), "fill_secret requires a valid secret_key alias")
        .when(kind == "navigate", url_error(F.col("url")))
        .when(F.col("risk").isNotNull() & ~F.lower("risk").isin("low", "medium", "high"), "Invalid action risk tier")
    )


ACTION = "type string, target_selector string, target_element_id string, secret_key string, text string, url string, reason string, target_bbox array<double>, confidence double, risk string"
_ACTIONS = (
    {"type": "click", "target_selector": "#next-page-btn"}, {"type": "type", "text": "mechanical keyboard"}, {"type": "click", "target_selector": "#submit-payment"}, {"type": "click", "text": "Place Order"},
    {"type": "click", "target_selector": "#delete-account-button"}, {"type": "click", "reason": "Send message to recipient"}, {"type": "click", "target_selector": "#change-password-submit"}, {"type": "scroll"}, {"type": "DONE"},
    {"type": "click"}, {"type": "launch"}, {"type": None}, {"type": "click", "text": "x", "confidence": 1.5}, {"type": "click", "target_selector": "a[onclick=x]"}, {"type": "click", "target_bbox": [1.0, 2.0]},
    {"type": "click", "target_bbox": [1.0, -2.0, 3.0, 4.0]}, {"type": "fill_secret", "target_element_id": "p"}, {"type": "fill_secret", "target_element_id": "p", "secret_key": "k"}, {"type": "navigate"}, {"type": "navigate", "url": "  "},
    {"type": "navigate", "url": "javascript:alert(1)"}, {"type": "navigate", "url": "https://example.com/a"}, {"type": "navigate", "url": "ftp://example.com"}, {"type": "navigate", "url": "example"}, {"type": "click", "text": "x", "risk": "huge"}, {"type": "submit"},
)


def sample_actions(spark: SparkSession) -> DataFrame:
    names = [c.split(" ")[0] for c in ACTION.split(", ")]
    return spark.createDataFrame([(k, *(a.get(n) for n in names)) for k, a in enumerate(_ACTIONS)], f"action_id long, {ACTION}")


def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action of one of the sampled kinds for each order; its target, url and texts carry the order's own."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").cast("string").alias("cust"), "o_orderpriority", "o_orderstatus")
    rows = own.join(F.broadcast(sample_actions(spark).withColumnRenamed("action_id", "kind")), F.col("key") % len(_ACTIONS) == F.col("kind"))
    url = F.when(F.trim("url") != "", F.concat("url", F.lit("/"), "cust")).otherwise(F.col("url"))
    added = {"target_selector": F.concat("target_selector", F.lit("-"), "cust"), "text": F.concat("text", F.lit(" "), "o_orderpriority"), "reason": F.concat("reason", F.lit(" "), "o_orderstatus"), "url": url}
    return rows.withColumns(added).withColumnRenamed("key", "action_id")


def action_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = action_error()
    return order_actions(spark, sf_dir).select("action_id", error.isNull().alias("valid"), error.alias("error"))


def risk_of(texts: Column, kind: Column, cross_origin: Column | None = None) -> Column:
    """struct(risk, category) from candidate texts in order; the first text with a risky pattern decides."""

    def first(t: Column) -> Column:
        out = None
        for category, pattern in P.HIGH_RISK:
            fits = t.rlike("(?i)" + pattern)
            out = F.when(fits, category) if out is None else out.when(fits, category)
        return out

    hit = F.try_element_at(F.filter(F.transform(texts, first), lambda c: c.isNotNull()), F.lit(1))
    kind = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    away = F.coalesce(cross_origin, F.lit(False)) if cross_origin is not None else F.lit(False)
    category = F.when(kind.isin(*P.LOW_RISK_TYPES), F.lit(None)).when(hit.isNotNull(), hit).when(kind == "submit", "submit").when((kind == "navigate") & away, "navigate")
    return F.struct(F.when(kind.isin(*P.LOW_RISK_TYPES), "low").when(category.isNotNull(), "high").otherwise("medium").alias("risk"), category.alias("category"))


def crosses_origin(url: Column, page_url: Column) -> Column:
    """Whether a url leads to another origin than the page's; relative and missing urls do not."""
    origin = lambda u: F.lower(F.regexp_extract(F.trim(u), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1))
    return F.coalesce((origin(url) != "") & (origin(url) != origin(page_url)), F.lit(False))


def element_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of derived actions by the labels of the elements that they point to (J8, F17), and of links that leave a page's origin."""
    from .planning import element_texts, elements_of

    rows = elements_of(spark, sf_dir).withColumn("label", F.when(F.col("ord") == 2, "Pay now").when(F.col("ord") == 3, "Delete item").otherwise(F.col("label")))
    actions = rows.where("ord = 1").select(F.col("page").alias("action_id"), "page", F.when(F.col("page") % 2 == 0, "e2").alias("target_element_id"), F.when(F.col("page") % 3 == 0, "#card-3").alias("target_selector"), "x", "y")
    told = actions.select("action_id").join(element_texts(actions, rows), "action_id", "left")
    away = crosses_origin(F.when(F.col("action_id") % 5 == 0, "https://B.org/x").when(F.col("action_id") % 5 == 1, "https://A.org/y").otherwise("/z"), F.lit("https://a.org/"))
    kind = F.when(F.col("action_id") % 7 < 3, "navigate").otherwise("click")
    return told.withColumn("r", risk_of(F.coalesce("texts", F.array().cast("array<string>")), kind, away)).select("action_id", "r.risk", "r.category")


def risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of all orders, and one action for each event type."""
    types = table(spark, sf_dir, "events").select("event_type").distinct().select(F.lit(-1).cast("long").alias("action_id"), F.lit("click").alias("type"), F.array("event_type").alias("texts"))
    literal = order_actions(spark, sf_dir).select("action_id", "type", F.filter(F.array("target_selector", "target_element_id", "text", "reason", "url", "secret_key"), lambda t: t.isNotNull()).alias("texts"))
    rows = literal.unionAll(types)
    return rows.withColumn("r", risk_of(F.col("texts"), F.col("type"))).select("action_id", F.array_join("texts", "|").alias("texts"), "r.risk", "r.category", (F.col("r.risk") == "high").alias("requires_confirmation"))


# Hosts, words of navigation and phrases by which an action leaves the task.
BAD_HOSTS = "evil.com|attacker|phishing|malicious|exploit|stealer"
NAV_WORDS = "navigate|go to|visit|open|url|http://|https://|browse|website"
INJECTION = "ignore task|override task|prompt injection|untrusted instruction"


def follows_task(kind: Column, url: Column, reason: Column, task: Column) -> Column:
    """Whether an action keeps to the user's task."""
    away = (kind == "navigate") & (F.coalesce(url, F.lit("")) != "") & (F.lower(url).rlike(BAD_HOSTS) | ~F.lower(task).rlike(NAV_WORDS))
    return ~(F.coalesce(away, F.lit(False)) | F.coalesce(F.lower(reason).rlike(INJECTION), F.lit(False)))


def task_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "Open the site").otherwise("buy tea").alias("task"), F.when(F.col("page_id") % 5 == 0, "I ignore task rules").alias("reason"))
    return rows.select("page_id", follows_task(F.lit("navigate"), F.col("url"), F.col("reason"), F.col("task")).alias("follows"))


def _sql(v) -> str:
    return "NULL" if v is None else f"[{', '.join(map(str, v))}]::DOUBLE[]" if isinstance(v, list) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


_A = ["type", "target_selector", "target_element_id", "secret_key", "text", "url", "reason", "target_bbox", "confidence", "risk"]
_ACTIONS_SQL = "v(kind, " + ", ".join(_A) + ") AS (VALUES " + ", ".join(f"({k}, " + ", ".join(_sql(a.get(n)) for n in _A) + ")" for k, a in enumerate(_ACTIONS)) + ")" + f""", a AS (SELECT CAST(o_orderkey AS BIGINT) AS action_id, v.* REPLACE (target_selector || '-' || o_custkey AS target_selector, text || ' ' || o_orderpriority AS text, reason || ' ' || o_orderstatus AS reason,
    CASE WHEN trim(url) <> '' THEN url || '/' || o_custkey ELSE url END AS url) FROM orders JOIN v ON o_orderkey % {len(_ACTIONS)} = kind)"""
_KW = lambda e: f"""coalesce(list_filter(list_transform(string_split_regex(regexp_replace({e}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+'), lambda t: lower(t)), lambda t: t IN ({', '.join(map(_sql, P.KEYWORDS))}))[1],
    CASE WHEN regexp_replace(lower({e}), '[^a-z0-9]', '', 'g') SIMILAR TO '.*(creditcard|cardnumber).*' THEN 'card' WHEN regexp_replace(lower({e}), '[^a-z0-9]', '', 'g') LIKE '%socialsecurity%' THEN 'ssn'
    WHEN regexp_replace(lower({e}), '[^a-z0-9]', '', 'g') SIMILAR TO '.*(securitycode|cvv|cvc).*' THEN 'card' END)"""  # noqa: E731
_CAT = lambda e: "CASE " + " ".join(f"WHEN regexp_matches({e}, '{p}') THEN '{c}'" for c, p in P.KEYWORD_CATEGORY) + f" ELSE {e} END"
_N = ["tag", "type", "autocomplete", "name", "id", "aria_label", "placeholder", "text", "data_pii_type", "n_children"]
_NODES_SQL = "v(kind, " + ", ".join(_N) + ") AS (VALUES " + ", ".join(f"({k}, " + ", ".join(_sql({"tag": t, **a}.get(c, 0 if c == "n_children" else "")) for c in _N) + ")" for k, (t, a) in enumerate(_NODES)) + ")" + f""", n AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, v.* REPLACE ({', '.join(f"CASE WHEN {c} <> '' THEN {c} || '{gap}' || {own} ELSE '' END AS {c}" for c, gap, own in (('name', '_', 'p_size'), ('id', '_', 'p_size'), ('text', ' ', 'p_name'), ('placeholder', ' ', 'p_type')))})
    FROM part JOIN v ON p_partkey % {len(_NODES)} = kind)"""
_RISK = " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{c}'" for c, p in P.HIGH_RISK)

QUERIES = {f.__name__: f for f in (sensitivity_cascade, keyword_classify, name_validate, field_refusal, action_validate, risk_tiers, element_risks, task_deviation)}
from .regions import _BOX  # noqa: E402

ORACLE = {
    "element_risks": f"""WITH {_BOX}, el AS (SELECT page, 'e' || ord AS id, '#' || category || '-' || ord AS sel, CASE ord WHEN 2 THEN 'Pay now' WHEN 3 THEN 'Delete item' ELSE category || ' ' || source END AS label, x, y, ord FROM b),
        m AS (SELECT a.page, e.label, e.id FROM el a JOIN el e ON a.page = e.page WHERE a.ord = 1 AND ((a.page % 2 = 0 AND e.id = 'e2') OR (a.page % 3 = 0 AND e.sel = '#card-3') OR (abs(a.x - e.x) < 10 AND abs(a.y - e.y) < 10))),
        r AS (SELECT DISTINCT page, id, CASE WHEN label = 'Pay now' THEN 'payment' WHEN label = 'Delete item' THEN 'delete' END AS c FROM m), f AS (SELECT page, first(c ORDER BY id) AS c FROM r WHERE c IS NOT NULL GROUP BY page),
        k AS (SELECT a.page, coalesce(f.c, CASE WHEN a.page % 7 < 3 AND a.page % 5 = 0 THEN 'navigate' END) AS c FROM el a LEFT JOIN f ON f.page = a.page WHERE a.ord = 1)
        SELECT page AS action_id, CASE WHEN c IS NULL THEN 'medium' ELSE 'high' END AS risk, c AS category FROM k""",
    "sensitivity_cascade": f"""WITH {_NODES_SQL}, k AS (SELECT *, {_KW('name')} AS kn, {_KW('aria_label')} AS ka, {_KW('placeholder')} AS kp, {_KW('id')} AS ki, {_KW("concat_ws(' ', name, id, aria_label, placeholder, text)")} AS ke, tag NOT IN ({', '.join(map(_sql, P.STRUCTURAL_TAGS))}) AS plain FROM n),
        r AS (SELECT node_id, CASE {' '.join(f"WHEN data_pii_type = '{a}' THEN '{c}:data_pii_{r}'" for a, (c, r) in P.PII_ATTRIBUTE.items())} WHEN data_pii_type <> '' THEN data_pii_type || ':data_pii_' || data_pii_type
        WHEN type = 'password' THEN 'password:type_password' WHEN regexp_matches(autocomplete, 'cc-[-a-z0-9]+') THEN 'card:autocomplete_card' WHEN regexp_matches(autocomplete, '\\bemail\\b') THEN 'email:autocomplete_email'
        WHEN regexp_matches(autocomplete, '\\btel(?:-[-a-z0-9]+)?\\b') THEN 'phone:autocomplete_tel' WHEN regexp_matches(autocomplete, '\\b(?:name|given-name|family-name|additional-name|nickname)\\b') THEN 'name:autocomplete_name'
        WHEN type = 'email' THEN 'email:type_email' WHEN type = 'tel' THEN 'phone:type_tel' WHEN type = 'number' AND ke IN ('card', 'cvv', 'cvc', 'pan') THEN 'card:type_number_card' WHEN type = 'number' AND ke = 'pin' THEN 'pin:type_number_pin'
        WHEN plain AND kn IS NOT NULL THEN {_CAT('kn')} || ':regex_name_' || kn WHEN plain AND ka IS NOT NULL THEN {_CAT('ka')} || ':regex_aria-label_' || ka WHEN plain AND kp IS NOT NULL THEN {_CAT('kp')} || ':regex_placeholder_' || kp
        WHEN plain AND ki IS NOT NULL AND n_children = 0 THEN {_CAT('ki')} || ':regex_id_' || ki WHEN regexp_matches(text, '{P.SQL_PATTERNS['card']}') THEN 'card:pattern_credit_card' WHEN regexp_matches(text, '{P.SQL_PATTERNS['ssn']}') THEN 'ssn:pattern_ssn' WHEN regexp_matches(text, '{P.EMAIL}') THEN 'email:pattern_email' END AS r FROM k)
        SELECT CAST(node_id AS BIGINT) AS node_id, nullif(split_part(r, ':', 1), '') AS category, nullif(split_part(r, ':', 2), '') AS rule FROM r""",
    "keyword_classify": f"SELECT ident, {_KW('ident')} AS keyword, CASE WHEN {_KW('ident')} IS NOT NULL THEN {_CAT(_KW('ident'))} END AS category FROM (SELECT p_name AS ident FROM part UNION VALUES "
    + ", ".join(f"({_sql(v)})" for v in [a[k] for _, a in _NODES for k in ("name", "id", "placeholder") if k in a] + ["userCardNumber", "SecurityCode", "x_cvc2"]) + ")",
    "name_validate": f"""SELECT name, length(trim(name)) BETWEEN 3 AND 40 AND lower(trim(name)) NOT IN ({', '.join(map(_sql, P.UI_WORDS))}) AND len(w) BETWEEN 2 AND 4
        AND len(list_filter(w, lambda x: NOT (regexp_matches(x, '^[A-Za-zÀ-ÖØ-öø-ÿ''. -]+$') AND (x[1] <> lower(x[1]) OR lower(x) IN ({', '.join(map(_sql, P.PARTICLES))}))))) = 0 AS valid
        FROM (SELECT name, list_filter(string_split_regex(trim(name), '\\s+'), lambda x: x <> '') AS w FROM (SELECT c_name AS name FROM customer UNION VALUES {', '.join(f'({_sql(n)})' for n in NAMES)}))""",
    "field_refusal": f"WITH {_NODES_SQL} SELECT CAST(node_id AS BIGINT) AS node_id, type = 'password' OR {' OR '.join(f'contains(lower(autocomplete), {_sql(c)})' for c in P.REFUSED_AUTOCOMPLETE)} OR {' OR '.join(f'regexp_matches({c}, {_sql(P.REFUSED_NAME)})' for c in ('name', 'id', 'placeholder', 'aria_label'))} AS refused FROM n",
    "action_validate": f"""WITH {_ACTIONS_SQL}, t AS (SELECT *, lower(coalesce(type, '')) AS k, lower(regexp_extract(trim(url), '^([a-zA-Z0-9+.-]+):', 1)) AS scheme FROM a),
        e AS (SELECT action_id, CASE WHEN k = '' THEN 'Missing or invalid action type' WHEN k NOT IN ({', '.join(map(_sql, ACTION_TYPES))}) THEN 'Unsupported action type: "' || k || '"' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'Action confidence must be between 0.0 and 1.0'
        WHEN regexp_matches(target_selector, '(?i)<script|javascript:|on[a-z0-9_]+=') THEN 'Potentially unsafe script injection in selector' WHEN len(target_bbox) < 4 THEN 'target_bbox must be an array of at least 4 numbers [x, y, w, h]'
        WHEN list_min(target_bbox[1:4]) < 0 THEN 'target_bbox values cannot be negative' WHEN k IN ('click', 'fill_secret') AND coalesce(target_selector, target_element_id, text, reason) IS NULL AND target_bbox IS NULL THEN 'Action "' || k || '" requires a target locator'
        WHEN k = 'fill_secret' AND secret_key IS NULL THEN 'fill_secret requires a valid secret_key alias' WHEN k = 'navigate' AND coalesce(url, '') = '' THEN 'navigate action requires a url string' WHEN k = 'navigate' AND trim(url) = '' THEN 'navigate action requires a non-empty url string'
        WHEN k = 'navigate' AND scheme IN ({', '.join(map(_sql, FORBIDDEN_SCHEMES))}) THEN 'Forbidden URL scheme "' || scheme || ':": navigation blocked for security' WHEN k = 'navigate' AND scheme = '' THEN 'Invalid URL format: "' || trim(url) || '"'
        WHEN k = 'navigate' AND scheme NOT IN ('http', 'https') THEN 'Unsupported URL scheme "' || scheme || ':": only http: and https: are allowed' WHEN lower(risk) NOT IN ('low', 'medium', 'high') THEN 'Invalid action risk tier' END AS error FROM t)
        SELECT CAST(action_id AS BIGINT) AS action_id, error IS NULL AS valid, error FROM e""",
    "risk_tiers": f"""WITH {_ACTIONS_SQL}, x AS (SELECT action_id, lower(coalesce(type, '')) AS k, list_filter([target_selector, target_element_id, text, reason, url, secret_key], lambda v: v IS NOT NULL) AS texts FROM a
        UNION ALL SELECT DISTINCT -1, 'click', [event_type] FROM events), u AS (SELECT row_number() OVER () AS r, * FROM x),
        h AS (SELECT r, arg_min(c, i) AS c FROM (SELECT r, i, CASE {_RISK} END AS c FROM (SELECT r, texts[i] AS t, i FROM (SELECT r, texts, unnest(range(1, len(texts) + 1)) AS i FROM u))) WHERE c IS NOT NULL GROUP BY r),
        z AS (SELECT u.*, CASE WHEN k IN ({', '.join(map(_sql, P.LOW_RISK_TYPES))}) THEN NULL WHEN c IS NOT NULL THEN c WHEN k = 'submit' THEN 'submit' END AS category FROM u LEFT JOIN h USING (r))
        SELECT CAST(action_id AS BIGINT) AS action_id, array_to_string(texts, '|') AS texts, CASE WHEN k IN ({', '.join(map(_sql, P.LOW_RISK_TYPES))}) THEN 'low' WHEN category IS NOT NULL THEN 'high' ELSE 'medium' END AS risk, category, category IS NOT NULL AS requires_confirmation FROM z""",
    "task_deviation": f"SELECT page_id, NOT ((url <> '' AND (regexp_matches(lower(url), '{BAD_HOSTS}') OR NOT page_id % 2 = 0)) OR page_id % 5 = 0) AS follows FROM pages",
}
