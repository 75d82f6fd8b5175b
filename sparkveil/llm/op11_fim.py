"""Fill-in-middle transformation: a text cut into prefix, middle and suffix, and put in another order.

The tokenizers library's ``Split`` pre-tokenizer, with a pattern whose matches it
isolates, gives the code-point offsets of a text's tokens; nothing is trained.  The
length of the offset array is n, and the offsets at two ranks, drawn from a hash of
the id, are where prefix and middle end.  The library sees a text in pieces of some
4,000 code points, cut where no token is: a text of any length takes four bytes a
token, not an object a token.

Only texts go to Python, and three numbers a text come back: the slices, the output
and the rebuilt text are built-in functions.  One pass, no shuffle.

Output: ``plain`` is the text; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm`` is
<S>suffix<P>prefix<M>middle.  A text that contains a mark stays plain, so each mark
stands once in an output and ``restored`` is exact.

Edge cases: null texts are empty; empty texts are plain with n = 0; a null id is hashed as an
empty string; repeated rows give equal rows; a token of any length is one token; no rows give no
rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# The tokens, the marks of prefix, suffix and middle, and the shares of forms in percent.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
PIECE = 4_000
_LETTERS = re.compile("[A-Za-z]*")


class Offsets:
    """Ends of a text's tokens, in code points, by the library's pre-tokenizer."""

    def __init__(self) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(TOKEN), behavior="isolated")

    def ends(self, text: str) -> array:
        out, at = array("I"), 0
        while at < len(text):
            end = at + PIECE
            if _LETTERS.match(text, end - 1, end).end() == end:  # the last one is a letter: its token goes on
                end = _LETTERS.match(text, end).end()
            out.extend([at + last for _, (_, last) in self.split.pre_tokenize_str(text[at:end])])
            at = end
        return out


def cut(one: pa.Array, other: pa.Array, texts: pa.Array) -> pa.Array:
    """The number of tokens of each text, and the ends of as many tokens as two drawn numbers leave over of n + 1, in order."""
    offsets, rows = Offsets(), []
    for a, b, text in zip(one.to_pylist(), other.to_pylist(), texts, strict=True):
        ends = offsets.ends(text.as_py())
        first, second = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
        rows.append((len(ends), ends[first - 1] if first else 0, ends[second - 1] if second else 0))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n", "first", "second"])


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def draw(k: int) -> Column:
        return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cutting = F.arrow_udf(cut, "struct<n:long,first:long,second:long>")
    rows = rows.select("doc_id", "text", cutting(draw(1), draw(2), F.col("text")).alias("c"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (draw(3) % 100 >= CHANGED), "plain").when(draw(4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", F.col("c.n").alias("n"), F.col("c.first").cast("int").alias("first"), F.col("c.second").cast("int").alias("second"), form.alias("form"))
    prefix, middle = F.substr("text", F.lit(1), F.col("first")), F.substr("text", F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substr("text", F.col("second") + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    changed = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.when(changed, F.col("first").cast("long")).alias("prefix_chars"),
        F.when(changed, (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output, from the output and its form alone."""

    def after(mark: str) -> Column:
        return F.substr(output, F.locate(mark, output) + len(mark))

    def between(mark: str, end: str) -> Column:
        return F.substring_index(after(mark), end, 1)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of output and rebuilt text of every document."""
    done = transform(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS units,
      CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
}
