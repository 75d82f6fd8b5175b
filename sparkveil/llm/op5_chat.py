"""Chat formatting by event sourcing: fold message events, then render.  Built-in functions only.

Events are rows (conv_id, slot, tie, seq, kind, role, text).  A message is the pair
(slot, tie) of a conversation; its events apply in the order of ``seq``:
``message`` and ``edit`` set the text, ``regenerate`` empties it and withdraws what
later slots held before it, ``delta`` appends.  A message whose events were all
withdrawn is gone.  Repeated rows of one event count once (``events_of`` tells equal
rows of whole turns apart, so each is a message).

The fold groups by message, so a conversation with a third of all rows is spread
over its messages; messages are rendered where they are folded, and a
conversation's rendering joins blocks of ``BLOCK`` slots before it joins the
blocks.  (One formatted conversation is one value, as it must be for its digest.)

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` per turn.  Inside roles and texts
``&``, ``<`` and ``[`` are written as ``&amp;``, ``&lt;`` and ``&#91;`` (and a role's line
breaks as ``&#10;``), so no control string of this or another common template can
occur in a text, and reading back is exact.  The loss mask is the list of
assistant texts' places in the output.

Edge cases: null texts and roles are empty; a null turn sorts first; a null conv_id is a
conversation of its own; several rows of one turn, equal or not, are as many turns, ordered by
role and text.  No rows give no conversation; columns other than conv_id, turn, role
and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

START, END = "<|im_start|>", "<|im_end|>\n"
# What is escaped, in the order of writing.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
BLOCK = 256
TRAINED_ROLE = "assistant"


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _joined(items: Column, part) -> Column:
    """Concatenate a part of each item of an ordered array."""
    return F.array_join(F.transform(items, part), "")


def withdrawn(rows: DataFrame) -> DataFrame:
    """``rows`` without the events that a later regeneration of an earlier slot withdraws.

    Regenerations are pre-aggregated by block of slots; each block knows the latest one of all earlier blocks
    (a running maximum over the blocks) and its own, so a long conversation is dealt by block.
    """
    block = F.floor(F.col("slot") / BLOCK)
    at = F.when(F.col("kind") == "regenerate", F.struct(F.col("slot").alias("at_slot"), F.col("seq").alias("at_seq")))
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("latest"), F.collect_set(at).alias("redone"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.max("latest").over(earlier)).where("before is not null or latest is not null")
    blocks = blocks.select(F.col("conv_id").alias("own_id"), F.col("block").alias("own_block"), "before", "redone")
    joined = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("own_id")) & (block == F.col("own_block")), "left")
    gone = (F.col("before") > F.col("seq")) | F.exists("redone", lambda r: (r.at_slot < F.col("slot")) & (r.at_seq > F.col("seq")))
    return joined.where(~F.coalesce(gone, F.lit(False))).select(rows.columns)


def fold(events: DataFrame, regenerated: bool = True) -> DataFrame:
    """(conv_id, slot, tie, role, text) of the messages that stand after all events; not ``regenerated``: no event is a regeneration."""
    rows = events.select("conv_id", F.coalesce("slot", F.lit(-(1 << 62))).alias("slot"), F.coalesce("tie", F.lit("")).alias("tie"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = withdrawn(rows) if regenerated else rows
    by_message = rows.groupBy("conv_id", "slot", "tie").agg(F.array_sort(F.collect_set(F.struct("seq", "kind", "role", "text"))).alias("e"))
    last = F.array_max(F.transform(F.filter("e", lambda x: x.kind != "delta"), lambda x: x.seq))
    live = F.filter("e", lambda x: F.col("last").isNull() | (x.seq > F.col("last")) | ((x.seq == F.col("last")) & (x.kind != "regenerate")))
    # of several settings at one seq the last in order counts
    text = F.aggregate("live", F.lit(""), lambda acc, x: F.when(x.kind == "delta", F.concat(acc, x.text)).otherwise(x.text))
    role = F.aggregate("e", F.lit(""), lambda acc, x: F.when(x.role != "", x.role).otherwise(acc))
    return by_message.withColumn("last", last).withColumn("live", live).select("conv_id", "slot", "tie", role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the output and the (start, length) of each trained text, in code points from 0."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    piece = messages.select("conv_id", "slot", "tie", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("skip"), F.when(F.col("role") == TRAINED_ROLE, F.length(body)).alias("trained"))
    # the loss places of a block count from its own start
    def gathered(frame: DataFrame, keys: list, order: list[str], block: Column) -> DataFrame:
        return frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "piece", "loss"))).alias("x")).select(*[k if isinstance(k, str) else block for k in keys], F.transform("x", lambda p: p.piece).alias("pieces"), "x")

    def placed(frame: DataFrame, *keep) -> DataFrame:
        """Join the pieces; shift each piece's loss places by the length of what precedes it."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
        moved = F.aggregate("x", start, lambda acc, p: F.struct((acc.at + F.length(p.piece)).alias("at"), F.concat(acc.loss, F.transform(p.loss, lambda s: F.struct((s.start + acc.at).alias("start"), s.length.alias("length")))).alias("loss")))
        return frame.select(*keep, F.array_join("pieces", "").alias("piece"), moved.getField("loss").alias("loss"))

    place = F.struct(F.col("skip").cast("int").alias("start"), F.col("trained").cast("int").alias("length"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    own = piece.select("conv_id", F.floor(F.col("slot") / BLOCK).alias("block"), "slot", "tie", "piece", F.when(F.col("trained").isNotNull(), F.array(place)).otherwise(none).alias("loss"))
    blocks = placed(gathered(own, ["conv_id", "block"], ["slot", "tie"], F.col("block")), "conv_id", "block")
    whole = placed(gathered(blocks, ["conv_id"], ["block"], F.col("block")), "conv_id")
    return whole.withColumnRenamed("piece", "formatted")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, turns): the turns parsed from the output alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(END))
        return F.struct(unescaped(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as events; every row is a message, equal rows too."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # a row's number only tells equal rows apart, so a rerun task may number them otherwise
    own = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return conversations.select("conv_id", F.col("turn").alias("slot"), F.concat(role, F.lit("\n"), text, F.lit("\0"), own).alias("tie"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), role.alias("role"), text.alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from their formatted form."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    got = read_back(render(fold(events_of(rows.unionAll(probe)), regenerated=False)))
    loss = _joined(F.col("loss"), lambda s: unescaped(F.substr("formatted", s.start + 1, s.length)))
    return got.withColumn("lost", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(_joined(F.col("turns"), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = {
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body,
      replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
