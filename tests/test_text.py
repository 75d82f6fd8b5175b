import pytest
from pyspark.sql import functions as F

from sparkveil.functions import patterns as P
from sparkveil.functions import text as X


def one(spark, column, *values):
    kind = lambda v: "array<string>" if isinstance(v, list) else "string"
    return spark.createDataFrame([values], ", ".join(f"c{k} {kind(v)}" for k, v in enumerate(values))).select(column.alias("r")).first().r


REDACTED = (
    ("Write to nadia.k@mail.test before noon", [], "Write to [REDACTED_EMAIL] before noon"),
    ("we billed 5105-1051 05105100 twice", [], "we billed [REDACTED_CARD] twice"),
    ("file 123-45-6789; ring +44 207 946 0958", [], "file [REDACTED_SSN]; ring [REDACTED_PHONE]"),
    ("Lena Ortiz signed, lena ortiz left, Lena Ortizova stayed", ["Lena Ortiz"], "[REDACTED_NAME] signed, [REDACTED_NAME] left, Lena Ortizova stayed"),
    (" [REDACTED_PHONE] ", [], " [REDACTED_PHONE] "),
    ("no digits here", ["  "], "no digits here"),
)


@pytest.mark.parametrize(("text", "names", "expect"), REDACTED)
def test_redact_text(spark, text, names, expect):
    assert one(spark, X.redact_text(F.col("c0"), F.col("c1")), text, names) == expect


def test_redact_text_options(spark):
    explicit = F.array(F.struct(F.lit("Q-77 (b)").alias("text"), F.lit("card").alias("category")), F.struct(F.lit("Ivo").alias("text"), F.lit(None).cast("string").alias("category")))
    out = X.redact_text(F.col("c0"), explicit=explicit, custom=(("ticket [0-9]+", "<T>"),), tokens={"email": "<mail >"}, disabled=("phone",))
    # a text that ends with a sign has no word bound behind it, so only whole words of explicit texts go
    assert one(spark, out, "Ivo sent ticket 12 to a@b.cd, 555-010-9999") == "[REDACTED_NAME] sent <T> to <mail >, 555-010-9999"


SLUGS = (
    ("http://site.test/users/nadia-k?x=1", [], "http://site.test/users/[REDACTED_NAME]?x=1"),
    ("http://site.test/find?a=1&author=nadia#top", [], "http://site.test/find?a=1&author=[REDACTED_NAME]#top"),
    ("http://uni.test/~nkay/list.html", [], "http://uni.test/~[REDACTED_NAME]/list.html"),
    ("http://site.test/staff/lena_ortiz", ["Lena Ortiz"], "http://site.test/staff/[REDACTED_NAME]"),
    ("http://site.test/staff/lenaortiz/", ["Lena Ortiz"], "http://site.test/staff/[REDACTED_NAME]/"),
    ("http://site.test/staff/lenas", ["Lena Ortiz"], "http://site.test/staff/lenas"),
)


@pytest.mark.parametrize(("url", "names", "expect"), SLUGS)
def test_redact_url(spark, url, names, expect):
    assert one(spark, X.redact_url(F.col("c0"), F.col("c1")), url, names) == expect


def test_spans(spark):
    text = "pay 6011 0009 9013 9424, or mail a.b@c.dd (ssn 219-09-9999) or call 020 794 6000"
    spans = one(spark, X.claimed_spans(F.col("c0")), text)
    assert [s.category for s in spans] == ["card", "email", "ssn", "phone"]
    assert all(text[s.start : s.end] == s.text for s in spans)


def test_accented_neighbours_and_idempotence(spark):
    text = "é1234-5678-9012-3456 and x@y.zz"
    clean = one(spark, X.redact_text(F.col("c0")), text)
    assert clean == "é[REDACTED_CARD] and [REDACTED_EMAIL]"
    assert one(spark, X.redact_text(F.col("c0")), clean) == clean


def test_keywords_and_names(spark):
    for ident, expect in (("member_ssn", "ssn"), ("panther", None), ("spinning", None), ("CreditCardExpiry", "card"), ("tax-number", "tax"), ("socialSecurity2", "social")):
        assert one(spark, X.keyword_of(F.col("c0")), ident) == expect, ident
    for name, expect in (("Lena de Ortiz", True), ("lena ortiz", False), ("Sign In", False), ("Lena", False), ("Lena 2 Ortiz", False)):
        assert one(spark, X.is_personal_name(F.col("c0")), name) is expect, name


def test_tokens_are_complete():
    assert set(P.TOKEN_OF.values()) == set(P.TOKENS)
