"""Text functions as Column expressions: redaction, spans, url slugs, keywords, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def token_of(category: Column) -> Column:
    """The typed token of a category; unknown categories count as pii."""
    known = F.create_map(*[F.lit(x) for k, v in P.TOKEN_OF.items() for x in (k, P.TOKENS[v])])
    return F.coalesce(F.element_at(known, F.lower(category)), F.lit(P.TOKENS["pii"]))


def _quoted(c: Column) -> Column:
    """A string as a literal inside a pattern."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def redact_url(url: Column, names: Column | None = None) -> Column:
    """Identity slugs in a url as tokens; ``names`` is an array whose slugs go as whole path segments."""
    token = P.TOKENS["name"]
    out = F.regexp_replace(url, P.USER_PATH, "$1" + token)
    out = F.regexp_replace(out, P.TILDE_PATH, "$1" + token)
    out = F.regexp_replace(out, P.USER_QUERY, "$1" + token)
    if names is None:
        return out

    def slugs(name: Column) -> Column:
        low = F.lower(F.trim(name))
        first = F.element_at(F.split(low, r"\s+"), 1)
        every = F.array(F.regexp_replace(low, r"\s+", "-"), F.regexp_replace(low, r"\s+", "_"), F.regexp_replace(low, "[^a-z0-9]", ""), F.when(low.rlike(r"\s") & (F.length(first) >= 4), first).otherwise(""))
        return F.filter(F.array_distinct(every), lambda s: F.length(s) >= 3)

    usable = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.length(F.trim(n)) >= 3)
    return F.aggregate(F.flatten(F.transform(usable, slugs)), out, lambda acc, s: F.regexp_replace(acc, F.concat(F.lit("(?i)(/)"), _quoted(s), F.lit(r"(?=/|\?|#|$)")), F.lit("$1" + token)))


def redact_text(text: Column, names: Column | None = None, disabled: tuple[str, ...] = (), explicit: Column | None = None, custom: tuple[tuple[str, str], ...] = (), tokens: dict[str, str] | None = None) -> Column:
    """Personal data as typed tokens: given texts, names, the caller's patterns, then cards, SSNs, e-mails, phones, then url slugs.

    ``explicit``: array of struct(text, category); ``custom``: (pattern, token); ``tokens``: other tokens by category.
    """
    tokens = P.TOKENS | (tokens or {})
    out = text

    def said(acc: Column, own: Column, token: Column) -> Column:
        return F.regexp_replace(acc, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), _quoted(F.trim(own)), F.lit(r"(?![A-Za-z0-9_])")), F.regexp_replace(token, r"([$\\])", r"\\$1"))

    if explicit is not None:
        given = F.filter(explicit, lambda e: F.trim(e.text) != "")
        known = F.create_map(*[F.lit(x) for k, v in P.TOKEN_OF.items() for x in (k, tokens[v])])
        out = F.aggregate(given, out, lambda acc, e: said(acc, e.text, F.coalesce(F.try_element_at(known, F.lower(F.coalesce(e.category, F.lit("name")))), F.lit(tokens["pii"]))))
        slugs_of = F.transform(F.filter(given, lambda e: F.coalesce(e.category, F.lit("name")) == "name"), lambda e: e.text)
        names = slugs_of if names is None else F.concat(slugs_of, F.coalesce(names, F.array().cast("array<string>")))
    if names is not None:
        given_names = F.filter(names, lambda n: F.trim(n) != "")
        out = F.aggregate(given_names, out, lambda acc, n: said(acc, n, F.lit(tokens["name"])))
    for pattern, token in custom:
        out = F.regexp_replace(out, pattern, token)
    # the patterns are costly at every digit, so texts that cannot match are let through on a cheap test
    kept = out
    for category, pattern in P.TEXT_PATTERNS:
        if category not in disabled:
            out = F.regexp_replace(out, pattern, tokens[category])
    out = F.when(kept.rlike(P.MAYBE), out).otherwise(kept) if names is None else out
    slugs = text.rlike("[/?&]")
    return F.when(F.trim(text).isin(*tokens.values()), text).when(slugs, redact_url(out, names)).otherwise(out)


def has_pii(text: Column) -> Column:
    """Whether a text holds anything that redact_text would replace by pattern; one pass."""
    return text.rlike("|".join(f"(?:{pattern})" for _, pattern in P.TEXT_PATTERNS))


def still_has_pii(clean: Column, raw: Column) -> Column:
    """Whether a redacted text still holds personal data; it can only if the raw text might have."""
    return F.when(raw.rlike(P.MAYBE), has_pii(clean)).otherwise(False)


def spans_of(text: Column, category: str, pattern: str) -> Column:
    """array<struct<category,text,start,end>> of a pattern's matches; offsets are code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<category:string,text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        first = acc.at + F.length(F.element_at(pieces, k))
        own = F.element_at(found, k)
        span = F.struct(F.lit(category).alias("category"), own.alias("text"), first.cast("int").alias("start"), (first + F.length(own)).cast("int").alias("end"))
        return F.struct((first + F.length(own)).cast("int").alias("at"), F.array_append(acc.out, span).alias("out"))

    numbers = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, start, step, lambda acc: acc.out)


def claimed_spans(text: Column) -> Column:
    """Spans of all categories in order of priority; one that overlaps a span kept before is dropped; sorted by start."""
    kept = None
    for category, pattern in P.SPAN_PATTERNS:
        own = spans_of(text, category, pattern)
        kept = own if kept is None else F.concat(kept, _free(own, kept))
    return F.array_sort(kept, lambda a, b: a.start - b.start)


def _free(own: Column, kept: Column) -> Column:
    return F.filter(own, lambda s: ~F.exists(kept, lambda k: (k.start < s.end) & (s.start < k.end)))


def keyword_of(text: Column) -> Column:
    """The first sensitive keyword of an identifier, or what its compact form contains; null if none."""
    tokens = F.split(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^a-zA-Z0-9]+")
    hits = F.filter(F.transform(tokens, F.lower), lambda t: t.isin(*P.KEYWORDS))
    compact = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return (
        F.when(F.size(hits) > 0, F.try_element_at(hits, F.lit(1)))
        .when(compact.contains("creditcard") | compact.contains("cardnumber"), "card")
        .when(compact.contains("socialsecurity"), "ssn")
        .when(compact.contains("securitycode") | compact.contains("cvv") | compact.contains("cvc"), "card")
    )


def category_of(keyword: Column) -> Column:
    """The category that a keyword stands for; an unknown keyword is its own."""
    out = None
    for category, pattern in P.KEYWORD_CATEGORY:
        fits = keyword.rlike(pattern)
        out = F.when(fits, category) if out is None else out.when(fits, category)
    return out.otherwise(keyword)


def is_personal_name(text: Column) -> Column:
    """2 to 4 words, 3 to 40 characters, capitalised but for particles, and no user-interface term."""
    name = F.trim(text)
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    good = F.forall(words, lambda w: w.rlike(P.NAME_WORD) & ((F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) | F.lower(w).isin(*P.PARTICLES)))
    return F.coalesce(F.length(name).between(3, 40) & ~F.lower(name).isin(*P.UI_WORDS) & F.size(words).between(2, 4) & good, F.lit(False))
