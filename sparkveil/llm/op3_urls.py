"""URL filters with redirect equivalence.  Built-in functions only.

Rules (host, path prefix, verdict) fit their host and all its subdomains if the url's path
starts with the rule's; the longest rule wins, of equal ones an allow.  Urls
without a rule follow the method: redirect edges (a table of its own, or a page's
``<meta http-equiv=refresh>``) and canonical-link edges (``<link rel=canonical>``) make
an undirected graph of urls; an alias of a blocked url, over any number of edges, is
blocked.  An explicit allow takes precedence: a url with an allow rule stays allowed
whatever its aliases are, and everything else without a blocked alias is allowed.

A url's identity in the graph is its host, path and query: scheme, fragment and the
host's case do not count, dot segments are resolved and an empty path is ``/``.  *All* canonical links and
refreshes of a page give edges (``canonical`` may be any word of ``rel``), resolved against the page's ``<base href>`` or url.
Components come from distributed star contractions; a
target that a third of all pages point to is split by the adaptive skew join.  Rules
are a bounded literal; no page text passes the scan but the extracted links.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and no aliases,
and is allowed; a link to the page itself or to nothing is no edge; a page that a rule blocks by its
path as written blocks its aliases even if the resolved path fits no rule; repeated pages are judged one by one;
columns other than page_id, url and html are not read; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.components import connected_components
from ._common import table

# The rules of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; an empty path is ``/``."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    whole = F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """A url's identity in the graph; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), resolved_path(path_of(url)), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(link: Column, url: Column) -> Column:
    """An absolute form of a link found on a page; null for one that leads nowhere."""
    own = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(own, link))
        .when((link == "") | F.startswith(link, F.lit("#")) | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(link, F.lit("?")), F.concat(own, path_of(url), link))
        .otherwise(F.concat(own, F.when(folder == "", "/").otherwise(folder), link))
    )


# The parts of a page, the first that fits at a place: comments, elements whose content is no markup, tags.  Quotes count after "=" only.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
_PART = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<({_RAW})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])|\z)|</?[a-z]{_REST}>"
_ATTRIBUTE = r"""(?s)[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""


def attributes(tag: Column) -> Column:
    """A tag's attributes, split once, as (name, value); of two of one name the first counts."""
    inner = F.regexp_extract(tag, r"(?s)^</?[A-Za-z][^\s/>]*(.*)>$", 1)

    def one(text: Column) -> Column:
        value = F.regexp_extract(text, r"(?s)=\s*(.*)$", 1)
        quoted = F.left(value, F.lit(1)).isin('"', "'")
        value = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(F.regexp_extract(text, r"^([^\s/>=]+)", 1)).alias("name"), F.trim(F.replace(value, F.lit("&amp;"), F.lit("&"))).alias("value"))

    return F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), one)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of (tag, attributes); empty if it has none."""
    return F.coalesce(F.get(F.filter(tag["own"], lambda a: a["name"] == name), 0)["value"], F.lit(""))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): url identities joined by canonical links and refresh redirects of the pages; comments, scripts and attribute values hold none."""
    html, url = F.col("html"), F.col("url")
    wanted = F.filter(F.regexp_extract_all(html, F.lit(_PART), F.lit(0)), lambda t: t.rlike(r"(?i)^<(?:link|meta|base)[\s/>]"))
    is_tag = lambda t, name: t["tag"].rlike(rf"(?i)^<{name}[\s/>]")
    canonical = F.transform(F.filter("tags", lambda t: is_tag(t, "link") & attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: attribute(t, "href"))
    to = lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)(?:^|[;,\s])url\s*=\s*[\"']?\s*([^\"'\s]+)", 1)
    refresh = F.transform(F.filter("tags", lambda t: is_tag(t, "meta") & (F.lower(attribute(t, "http-equiv")) == "refresh")), to)
    base = F.get(F.filter(F.transform(F.filter("tags", lambda t: is_tag(t, "base")), lambda t: attribute(t, "href")), lambda h: h != ""), 0)
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(F.array(F.transform(wanted, lambda t: F.struct(t.alias("tag"), attributes(t).alias("own"))))).alias("tags"))
    found = found.select("url", base.alias("base"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("link"))
    found = found.select("url", F.coalesce(resolved(F.col("base"), url), url).alias("from"), "link")
    edges = found.select(node_of(url).alias("a"), node_of(resolved(F.col("link"), F.col("from"))).alias("b"))
    return edges.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``redirects`` has url columns src and dst."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).where("a is not null and b is not null and a <> b"))
    groups, _ = scratch.write(connected_components(edges))
    judged = pages.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    # a url in the graph need not be a page: its rule counts all the same
    at = F.concat(F.lit("http://"), F.col("node"))
    ruled = groups.select("component", rule_of(host_of(at), path_of(at), rules).getField("verdict").alias("verdict"))
    # a page's path as written may fit a rule that its resolved path does not
    written = judged.where((F.col("own.verdict") == "block") & (F.col("path") != resolved_path(F.col("path")))).select("node", "own.verdict")
    ruled = ruled.unionAll(groups.join(written, "node").select("component", "verdict"))
    blocked = ruled.where("verdict = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("bad"))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.join(aliases, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(table(spark, sf_dir, "pages"))


#: As far as SQL goes: all links of a page, but no dot segments and no ``<base>`` (a Python version in the tests has them).
ORACLE = {
    "op3_url_filter": r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url, coalesce(position('://' IN url), 0) > 0 AS abs,
         lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS query FROM pages),
tags AS (SELECT host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS a,
         unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style|<title\b.*?</title|<textarea\b.*?</textarea', '', 'g'), '(?is)<[a-z](?:[^>=]|=\s*"[^"]*"|=\s*''[^'']*''|=)*>')) AS tag FROM p WHERE abs),
parts AS (SELECT host, path, a, tag,
         regexp_extract(tag, '(?is)^<[^\s/>]+(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?)*?[\s/]+rel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS rel,
         regexp_extract(tag, '(?is)^<[^\s/>]+(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?)*?[\s/]+href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS href,
         regexp_extract(tag, '(?is)^<[^\s/>]+(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?)*?[\s/]+http-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS equiv,
         regexp_extract(tag, '(?is)^<[^\s/>]+(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?)*?[\s/]+content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS content FROM tags),
l AS (SELECT host, path, a, trim(replace(CASE WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(string_split_regex(lower(trim(rel, chr(34) || chr(39))), '\s+'), 'canonical') THEN trim(href, chr(34) || chr(39))
        WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim(equiv, '"'' ')) = 'refresh' THEN regexp_extract(trim(content, chr(34) || chr(39)), '(?is)(?:^|[;,\s])url\s*=\s*["'']?\s*([^"''\s]+)', 1) ELSE '' END, '&amp;', '&')) AS link FROM parts),
t AS (SELECT a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN 'http:' || link
      WHEN link LIKE '/%' THEN 'http://' || host || link WHEN link = '' OR link LIKE '#%' OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN link LIKE '?%' THEN 'http://' || host || path || link
      ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS target FROM l),
e AS (SELECT a, lower(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/')
      || regexp_extract(target, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS b FROM t WHERE position('://' IN target) > 0),
pairs AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM pairs UNION SELECT r.a, x.b FROM reach r JOIN pairs x ON r.b = x.a),
rules(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
known AS (SELECT a AS node, regexp_extract(a, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM pairs GROUP BY a),
nodes AS (SELECT node, arg_max(verdict, length(h || q)) AS verdict FROM known JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q) GROUP BY node),
bad AS (SELECT DISTINCT r.a FROM reach r JOIN nodes n ON n.node = r.b WHERE n.verdict = 'block'),
own AS (SELECT page_id, url, arg_max(verdict, length(h || q)) AS verdict, arg_max(h || q, length(h || q)) AS rule
        FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q) GROUP BY page_id, url)
SELECT p.page_id, host, path, rule, coalesce(own.verdict, CASE WHEN abs AND host || CASE WHEN path = '' THEN '/' ELSE path END || query IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN own ON p.page_id IS NOT DISTINCT FROM own.page_id AND p.url = own.url
"""
}
