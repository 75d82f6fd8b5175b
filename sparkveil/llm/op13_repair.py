"""Conversation structure repair: a forward Viterbi pass over the states of the turn grammar.

Grammar of the role initials: ``(s?(ua)+)?``.  States: nothing yet, after ``s``, after
``u``, after ``a``.  A layer is one row: each state keeps the least (cost, audit) of
all edits that lead to it; it is closed with at most two inserts, as a third would lead
back.  From a given state an audit names one path only, so no two
of equal cost are prefixes of each other, and the least of a layer stays the least
whatever follows.

The pass needs no text.  Rows travel as (conversation, turn, role, SHA-256 of the text,
copies), equal rows as one, and are dealt by ranges of their order, so that a
conversation with a third of all rows is cut into many segments.  A segment's pass
starts from each of the four states (from the first alone where it is sure to begin
its conversation) and gives a table of 4 x 4 (cost, audit); the tables of a
conversation are then chained in order, which fixes each segment's path, and the
segments' rows get their edits where they lie.  Texts move twice: to meet their
edits, and into the order of their conversation for the digest, which reads them as a
stream (a digest is sequential; its memory is constant).

Faults: the first of blank (no character but white space), duplicate (role and text
seen earlier), truncated (no sentence end at the end).  A duplicate is found by the least turn of its
(conversation, role, digest), pre-aggregated and joined back.

Edge cases: null conv_id is a conversation of its own; null turns come first and leave no gaps;
null roles and texts are one space; rows of one turn are in the order of role, then of the text's
SHA-256; equal rows are copies; a role that is empty or begins with another initial cannot be
kept, only rewritten or deleted; a conversation without rows has zeros, no edits and no text; an
empty table gives no rows; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkveil.plans import scratch

from ._common import table

# The grammar's states and steps, the costs of edits, the white space of blank texts.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
FINAL = (NOTHING, AFTER_A)
STEPS = {"s": {NOTHING: AFTER_S}, "u": {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
SPOKEN = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT, FINE = 1, 2, 3, 0
#: Most rows of a segment.
SEGMENT = 1_024
KEYS = ("conv_id", "turn", "role", "digest")

Best = dict[int, tuple[int, str]]
#: What can follow each state by an edit that writes a role: (initial, next state).
_NEXT = {state: [(c, steps[state]) for c, steps in STEPS.items() if state in steps and c in SPOKEN] for state in range(4)}


def _close(layer: Best) -> Best:
    """The layer after at most two inserts."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            for _, to in _NEXT[state]:
                new = (cost + INSERT, audit + "I")
                if to not in layer or new < layer[to]:
                    layer[to] = new
    return layer


def _advance(layer: Best, initial: str, fault: int) -> Best:
    """The layer after one more row, closed."""
    out = {state: (cost + DELETE, audit + "D") for state, (cost, audit) in layer.items()}
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for state, (cost, audit) in layer.items():
            options = [(to, cost + REROLE + more, audit + "R") for _, to in _NEXT[state]]
            kept = STEPS.get(initial, {}).get(state)
            if kept is not None:
                options.append((kept, cost + KEEP + more, audit + "K"))
            for to, *new in options:
                if to not in out or tuple(new) < out[to]:
                    out[to] = tuple(new)
    return _close(out)


def flagged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault, copies): the rows without their texts, equal rows as one."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    light = rows.select("conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("digest"), fault.alias("fault"))
    light = light.groupBy(*KEYS, "fault").agg(F.count("*").alias("copies"))
    # nulls come first among turns: (is there a turn, the turn)
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    repeated = F.col("first").isNotNull() & (at > F.col("first")) & (F.col("fault") != BLANK)
    return light.join(firsts, same, "left").select(*KEYS, F.substring("role", 1, 1).alias("initial"), F.when(repeated, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "copies")


_SEGMENT_FIELDS = "part int, seq int, turns array<long>, roles array<string>, digests array<string>, copies array<long>, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, opens string, ends string, n_turns long"


def segments(light: DataFrame, most: int = SEGMENT) -> DataFrame:
    """One row for each run of at most ``most`` rows of a conversation: its rows' keys, its counts and its table of costs and audits."""

    def fold(conv, rows: list[tuple], seq: int, sure: bool) -> dict:
        starts = (NOTHING,) if sure and seq == 0 else range(4)
        costs, audits = [None] * 16, [None] * 16
        for start in starts:
            layer = {start: (0, "")}
            if sure and seq == 0:
                _close(layer)
            for _, _, _, initial, fault, _ in rows:
                layer = _advance(layer, initial, fault)
            for end, (cost, audit) in layer.items():
                costs[4 * start + end], audits[4 * start + end] = cost, audit
        counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, FINE: 0}
        illegal, turns, before = 0, [], None
        for turn, _, _, initial, fault, copies in rows:
            counts[fault] += 1
            # further copies are blank where the first is, else duplicates
            counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
            illegal += copies - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
            before = initial
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
        extra = DELETE * sum(r[5] - 1 for r in rows)
        return {
            "conv_id": conv, "part": TaskContext.get().partitionId(), "seq": seq, "turns": [r[0] for r in rows], "roles": [r[1] for r in rows], "digests": [r[2] for r in rows], "copies": [r[5] for r in rows],
            "costs": [None if c is None else c + extra for c in costs], "audits": audits, "blank": counts[BLANK], "duplicate": counts[DUPLICATE], "truncated": counts[CUT], "illegal": illegal,
            "opens": rows[0][3], "ends": rows[-1][3], "n_turns": len(turns),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, seq, sure, ready = None, [], 0, False, []
        for batch in batches:
            for conv, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if own is None or own[0] != conv:
                    if rows:
                        ready.append(fold(own[0], rows, seq, sure))
                    # a task's first conversation may have begun in the task before
                    own, rows, seq, sure = (conv,), [], 0, own is not None
                elif len(rows) == most:
                    ready.append(fold(conv, rows, seq, sure))
                    rows, seq = [], seq + 1
                rows.append(row)
                if len(ready) == 256:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if rows:
            ready.append(fold(own[0], rows, seq, sure))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    fields = f"conv_id {dict(light.dtypes)['conv_id']}, {_SEGMENT_FIELDS}"
    schema = to_arrow_schema(light.sparkSession.createDataFrame([], fields).schema)
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    dealt = light.select(*KEYS, "initial", "fault", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, fields)


def _earlier(a: tuple, b: tuple) -> bool:
    """Whether audit ``a`` comes before ``b``; both are chains of (start, audit) over the same segments."""
    for k, ((_, x), (_, y)) in enumerate(zip(a, b, strict=True)):
        if x != y:
            if x.startswith(y) or y.startswith(x):  # inserts at a segment's end: what follows decides
                return "".join(z for _, z in a[k:]) < "".join(z for _, z in b[k:])
            return x < y
    return False


_CHAIN_FIELDS = "part int, seq int, start int, audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def chained(parts: DataFrame) -> DataFrame:
    """(conv_id, part, seq, start, audit) of each segment on its conversation's cheapest path; the last one also has the conversation's cost and counts."""
    fields = f"conv_id {dict(parts.dtypes)['conv_id']}, {_CHAIN_FIELDS}"
    schema = to_arrow_schema(parts.sparkSession.createDataFrame([], fields).schema)

    def rows_of(conv, members: list[dict]) -> list[dict]:
        chains = {NOTHING: (0, ())}
        if any(c is not None for c in members[0]["costs"][4:]):  # its table does not close the layer before the first row
            chains = {state: (cost, (audit,)) for state, (cost, audit) in _close({NOTHING: (0, "")}).items()}
            lead = {state: audit[0] for state, (_, audit) in chains.items()}
            chains = {state: (cost, ()) for state, (cost, _) in chains.items()}
        else:
            lead = {}
        for m in members:
            new: dict[int, tuple[int, tuple]] = {}
            for start, (cost, chain) in chains.items():
                for end in range(4):
                    if m["costs"][4 * start + end] is None:
                        continue
                    own = m["audits"][4 * start + end]
                    option = (cost + m["costs"][4 * start + end], (*chain, (start, own if chain else lead.get(start, "") + own)))
                    if end not in new or option[0] < new[end][0] or (option[0] == new[end][0] and _earlier(option[1], new[end][1])):
                        new[end] = option
            chains = new
        cost, path = None, ()
        for end in FINAL:
            if end in chains and (cost is None or chains[end][0] < cost or (chains[end][0] == cost and _earlier(chains[end][1], path))):
                cost, path = chains[end]
        out = [{"conv_id": conv, "part": m["part"], "seq": m["seq"], "start": start, "audit": audit} for m, (start, audit) in zip(members, path, strict=True)]
        pairs = list(zip(members, members[1:], strict=False))
        known = [m for m in members if m["least"] is not None]
        distinct = sum(m["n_turns"] for m in members) - sum(a["most"] == b["least"] for a, b in zip(known, known[1:], strict=False))
        out[-1] |= {k: sum(m[k] for m in members) for k in ("blank", "duplicate", "truncated", "illegal")}
        out[-1]["illegal"] += sum(a["ends"] + b["opens"] not in ("su", "ua", "au") for a, b in pairs)
        out[-1] |= {"cost": cost, "gaps": known[-1]["most"] - known[0]["least"] + 1 - distinct if known else 0}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[dict] = []
        ready: list[dict] = []
        for batch in batches:
            for m in batch.to_pylist():
                if members and members[0]["conv_id"] != m["conv_id"]:
                    ready += rows_of(members[0]["conv_id"], members)
                    members = []
                members.append(m)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if members:
            yield pa.RecordBatch.from_pylist(rows_of(members[0]["conv_id"], members), schema)

    tables = parts.select("conv_id", "part", "seq", "costs", "audits", "blank", "duplicate", "truncated", "illegal", "opens", "ends", "n_turns", F.array_min("turns").alias("least"), F.array_max("turns").alias("most"))
    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, fields)


def edits(parts: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, digest, audit, before, written, after): each row's edits; ``written`` is its role afterwards, null if deleted."""
    fields = f"conv_id {dict(parts.dtypes)['conv_id']}, place long, turn long, role string, digest string, audit string, before array<string>, written string, after array<string>"
    schema = to_arrow_schema(parts.sparkSession.createDataFrame([], fields).schema)

    def insert(state: int) -> tuple[str, int]:
        initial, to = _NEXT[state][0]
        return SPOKEN[initial], to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                state, at, audit = m["start"], 0, m["audit"]
                if m["led"]:  # inserts before the first row are counted from the start of the grammar
                    state = NOTHING
                for k, (turn, role, digest, copies) in enumerate(zip(m["turns"], m["roles"], m["digests"], m["copies"], strict=True)):
                    before, after, written = [], [], None
                    while audit[at] == "I":
                        name, state = insert(state)
                        before.append(name)
                        at += 1
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        written, state = role, STEPS[role[0]][state]
                    elif edit == "R":
                        written, state = insert(state)
                    while audit[at : at + 1] == "I":
                        name, state = insert(state)
                        after.append(name)
                        at += 1
                    own = "I" * len(before) + edit + "D" * (copies - 1) + "I" * len(after)
                    out.append({"conv_id": m["conv_id"], "place": m["part"] << 44 | m["seq"] << 20 | k, "turn": turn, "role": role, "digest": digest, "audit": own, "before": before, "written": written, "after": after})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    paths = chains.select(F.col("part").alias("c_part"), F.col("seq").alias("c_seq"), F.col("conv_id").alias("c_conv"), "start", "audit")
    same = (F.col("part") == F.col("c_part")) & (F.col("seq") == F.col("c_seq")) & F.col("conv_id").eqNullSafe(F.col("c_conv"))
    led = F.col("audit").startswith("I")
    rows = parts.select("conv_id", "part", "seq", "turns", "roles", "digests", "copies").join(paths, same)
    return rows.select("conv_id", "part", "seq", "turns", "roles", "digests", "copies", "start", "audit", led.alias("led")).mapInArrow(run, fields)


def _key() -> Column:
    """One value for what tells rows apart; nulls count."""
    return F.to_json(F.struct(*KEYS))


def repair(rows: DataFrame, most: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and faults of conversations.

    Turns: (conv_id, place, audit, said) for each row, equal rows as one, in the order of
    ``place``: its edits' initials and the turns (role, text) that stand in its place.
    Faults: (conv_id, gaps, blank, duplicate, truncated, illegal, cost).
    """
    light, light_path = scratch.write(flagged(rows))
    parts, _ = scratch.write(segments(light, most))
    scratch.drop(rows.sparkSession, light_path)
    chains, _ = scratch.write(chained(parts))
    text = F.coalesce("text", F.lit(" "))
    whole = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    whole = whole.groupBy(_key().alias("key")).agg(F.min("text").alias("text"))
    own = edits(parts, chains).withColumn("key", _key()).join(whole, "key", "left")

    def said(names: Column) -> Column:
        return F.transform(names, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

    kept = F.when(F.col("written").isNotNull(), F.array(F.struct(F.col("written").alias("role"), F.col("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    turns = own.select("conv_id", "place", "audit", F.concat(said(F.col("before")), kept, said(F.col("after"))).alias("said"))
    faults = chains.where("cost is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return turns, faults


def written(turns: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): all edits of a conversation, and the digest of its turns as ``role:text`` lines.  A conversation is read as a stream."""
    fields = f"conv_id {dict(turns.dtypes)['conv_id']}, audit string, repaired_sha256 string"
    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], fields).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, audit, first, ready = None, None, [], True, []

        def row() -> dict:
            return {"conv_id": own[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for conv, edit, lines in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        ready.append(row())
                    own, digest, audit, first = (conv,), hashlib.sha256(), [], True
                audit.append(edit)
                for line in lines:
                    digest.update(line if first else b"\n" + line)
                    first = False
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    lines = F.transform("said", lambda t: F.concat(t.role, F.lit(":"), t.text).cast("binary"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "audit", lines.alias("lines")).mapInArrow(run, fields)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the faults that the contract plants by crc32(conv_id:turn) % 20; nulls count as one space."""

    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("again", "times")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every conversation, damaged as the contract says."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, faults = repair(damaged(rows))
    lines = written(turns).withColumnRenamed("conv_id", "w_conv")
    faults = faults.withColumnRenamed("conv_id", "f_conv")
    every = rows.select("conv_id").distinct()
    joined = every.join(faults, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left").join(lines, F.col("conv_id").eqNullSafe(F.col("w_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


ORACLE = {
    "op13_conversation_repair": r"""
WITH RECURSIVE bits AS (SELECT i AS byte, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS m FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hit AS (SELECT src.* EXCLUDE (name), xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
            lambda a, x: xor(a >> 8, m[CAST(xor(a, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM src, crc),
dam AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM dam),
fau AS (SELECT conv_id, turn, role, text, k, role[1:1] AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM num),
r AS (SELECT conv_id, turn, role, text, k, i, before, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
      bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM fau),
f AS (SELECT *, blank OR duplicate AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM r),
-- each state's best as (cost, audit, text): n nothing, s, u, a; a layer, closed with inserts u <- n, s, a and a <- u
path AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS k, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS n, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s,
           {'c': CAST(5 AS BIGINT), 'a': 'I', 't': chr(10) || 'user:'} AS u, {'c': CAST(10 AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, k, n, s, list_min([u1, CASE WHEN a1 IS NOT NULL THEN {'c': a1.c + 5, 'a': a1.a || 'I', 't': a1.t || chr(10) || 'user:'} END]) AS u,
           list_min([a1, CASE WHEN u1 IS NOT NULL THEN {'c': u1.c + 5, 'a': u1.a || 'I', 't': u1.t || chr(10) || 'assistant:'} END]) AS a
    FROM (SELECT conv_id, k, n, s, a0 AS a1,
            list_min([u0, {'c': n.c + 5, 'a': n.a || 'I', 't': n.t || chr(10) || 'user:'}, CASE WHEN s IS NOT NULL THEN {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'} END]) AS u1
          FROM (SELECT p.conv_id, f.k, {'c': p.n.c + 2, 'a': p.n.a || 'D', 't': p.n.t} AS n,
                  list_min([CASE WHEN p.s IS NOT NULL THEN {'c': p.s.c + 2, 'a': p.s.a || 'D', 't': p.s.t} END,
                            CASE WHEN NOT gone AND i = 's' THEN {'c': p.n.c + more, 'a': p.n.a || 'K', 't': p.n.t || chr(10) || role || ':' || text} END]) AS s,
                  list_min([CASE WHEN p.u IS NOT NULL THEN {'c': p.u.c + 2, 'a': p.u.a || 'D', 't': p.u.t} END,
                            CASE WHEN NOT gone AND i = 'u' THEN {'c': p.n.c + more, 'a': p.n.a || 'K', 't': p.n.t || chr(10) || role || ':' || text} END,
                            CASE WHEN NOT gone AND i = 'u' AND p.s IS NOT NULL THEN {'c': p.s.c + more, 'a': p.s.a || 'K', 't': p.s.t || chr(10) || role || ':' || text} END,
                            CASE WHEN NOT gone AND i = 'u' AND p.a IS NOT NULL THEN {'c': p.a.c + more, 'a': p.a.a || 'K', 't': p.a.t || chr(10) || role || ':' || text} END,
                            CASE WHEN NOT gone THEN {'c': p.n.c + more + 1, 'a': p.n.a || 'R', 't': p.n.t || chr(10) || 'user:' || text} END,
                            CASE WHEN NOT gone AND p.s IS NOT NULL THEN {'c': p.s.c + more + 1, 'a': p.s.a || 'R', 't': p.s.t || chr(10) || 'user:' || text} END,
                            CASE WHEN NOT gone AND p.a IS NOT NULL THEN {'c': p.a.c + more + 1, 'a': p.a.a || 'R', 't': p.a.t || chr(10) || 'user:' || text} END]) AS u0,
                  list_min([CASE WHEN p.a IS NOT NULL THEN {'c': p.a.c + 2, 'a': p.a.a || 'D', 't': p.a.t} END,
                            CASE WHEN NOT gone AND i = 'a' AND p.u IS NOT NULL THEN {'c': p.u.c + more, 'a': p.u.a || 'K', 't': p.u.t || chr(10) || role || ':' || text} END,
                            CASE WHEN NOT gone AND p.u IS NOT NULL THEN {'c': p.u.c + more + 1, 'a': p.u.a || 'R', 't': p.u.t || chr(10) || 'assistant:' || text} END]) AS a0
                FROM path p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = p.k + 1) x) y
),
best AS (SELECT conv_id, k, list_min([n, a]) AS b FROM path),
ends AS (SELECT conv_id, arg_max(b, k) AS b FROM best GROUP BY conv_id),
tot AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       e.b.c AS cost, e.b.a AS audit, sha256(e.b.t[2:]) AS repaired_sha256
FROM ends e LEFT JOIN tot ON e.conv_id IS NOT DISTINCT FROM tot.conv_id
"""
}
