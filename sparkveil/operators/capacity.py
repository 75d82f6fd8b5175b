"""Step counters of a store with a time to live and room for so many keys.

The store drops the key written longest ago when it is full, so a key is gone at its next write if it was idle for too long
or if as many other keys as there is room for were written since.  How many distinct keys that is (its reuse distance) is
counted offline: writes have a place in the order of time, and ``prev`` is the place of the key's last write.  The keys
between ``prev`` and a write are the writes there whose own ``prev`` is earlier; all writes up to ``prev`` have an
earlier one too, so the distance is the number of earlier writes with a smaller ``prev``, less ``prev``.

That is a count of dominated points, in two levels.  Writes are dealt by ranges of time into parts (at most ``PARTS``); a ``prev``
is the ``prev`` of one write only, so writes dealt by the part of their ``prev`` are as few as a part has.  A write counts whole
(part, part of ``prev``) cells by running sums, its own part and its own part of ``prev`` exactly.  A key with a
third of all writes is dealt over the parts as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import scratch
from ..sources import table
from .state import TTL_SECONDS, micros

CAPACITY = 10_000
#: Most parts, and the writes that a part has at least where there are enough.
PARTS, PART_ROWS = 1_024, 50_000


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each of distinct numbers, how many smaller ones stand before it."""
    rank = np.argsort(np.argsort(values))
    order, out = np.arange(rank.size), np.zeros(rank.size, np.int64)
    for bit in reversed(range(int(rank.size).bit_length())):
        own = rank[order]
        upper = (own >> bit) & 1
        zeros = np.cumsum(1 - upper)
        starts = np.flatnonzero(np.diff(own >> (bit + 1), prepend=-1))
        base = np.repeat(zeros[starts] - 1 + upper[starts], np.diff(np.append(starts, rank.size)))
        out[order[upper == 1]] += (zeros - base)[upper == 1]
        order = order[np.argsort(own >> bit, kind="stable")]
    return out


def _dominated(rows: DataFrame, group: str, before: str, value: str, name: str) -> DataFrame:
    """(at, name): in each group, ordered by ``before``, how many rows with a smaller ``value`` stand before; rows with equal ``before`` do not count each other."""

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        at, first, second = (t.column(c).to_numpy() for c in ("at", before, value))
        # of equal ``before`` the greater value comes first, so none counts another
        order = np.lexsort((-second, first))
        yield pa.record_batch([pa.array(at[order]), pa.array(smaller_before(second[order]))], names=["at", name])

    return rows.select(*dict.fromkeys([group, "at", before, value])).groupBy(group).applyInArrow(run, f"at long, {name} long")


def placed(events: DataFrame, key: str, ts: str, tie: str, parts: int | None = None) -> DataFrame:
    """(event, k, us, part, at, prev): writes with their place in time from one, and the place of the key's last write (null: none)."""
    own = events.select(F.col(tie).alias("event"), F.col(key).alias("k"), micros(ts).alias("us"))
    if parts is None:
        parts = max(1, min(PARTS, own.count() // PART_ROWS))
    sorted_, path = scratch.write(own.repartitionByRange(parts, "us", "event").sortWithinPartitions("us", "event").withColumn("id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND((1 << 33) - 1) + 1
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rows = sorted_.withColumn("part", part).withColumn("inside", inside).join(F.broadcast(sizes), "part")
    rows = rows.select("event", "k", "us", "part", (F.col("inside") + F.col("ahead")).alias("at"))
    # the last write in the same part, else in the last part that has the key
    rows = rows.withColumn("prev", F.lag("at").over(Window.partitionBy("part", "k").orderBy("at")))
    ends = rows.groupBy("part", "k").agg(F.max("at").alias("last")).withColumn("earlier", F.lag("last").over(Window.partitionBy("k").orderBy("part"))).where("earlier is not null")
    ends = ends.select(F.col("part").alias("e_part"), F.col("k").alias("e_k"), "earlier")
    joined = rows.join(ends, (F.col("part") == F.col("e_part")) & F.col("k").eqNullSafe(F.col("e_k")), "left")
    out, _ = scratch.write(joined.select("event", "k", "us", "part", "at", F.coalesce("prev", "earlier").alias("prev")))
    scratch.drop(events.sparkSession, path)
    return out


def distances(rows: DataFrame) -> DataFrame:
    """(at, others) of the ``placed`` writes that have a ``prev``: how many other keys were written since."""
    spark = rows.sparkSession
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fresh = rows.groupBy("part").agg(F.count_if(F.col("prev").isNull()).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("new_ahead"))
    inside = F.sum(F.col("prev").isNull().cast("long")).over(Window.partitionBy("part").orderBy("at"))
    known = rows.withColumn("new", inside).where("prev is not null").join(F.broadcast(fresh), "part")
    # a prev is a place too: the write there says which part it is in
    known = known.select("part", "at", "prev", (F.col("new") + F.col("new_ahead")).alias("new")).join(rows.select(F.col("at").alias("prev"), F.col("part").alias("p_part")), "prev")
    known, _ = scratch.write(known)
    cells = known.groupBy("part", "p_part").agg(F.count("*").alias("n"))
    side = (rows.agg(F.max("part")).first()[0] or 0) + 1
    grid = spark.range(side * side).select((F.col("id") / side).cast("int").alias("part"), (F.col("id") % side).cast("int").alias("p_part")).join(cells, ["part", "p_part"], "left")
    above = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("p_part").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    corner = F.sum(F.coalesce("above", F.lit(0))).over(Window.partitionBy("part").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("above", above).withColumn("corner", F.coalesce(corner, F.lit(0))).where("n is not null").select("part", "p_part", "corner")
    counted = known.join(F.broadcast(grid) if side <= 256 else grid, ["part", "p_part"]).join(_dominated(known, "part", "at", "prev", "in_part"), "at").join(_dominated(known, "p_part", "part", "prev", "in_prev"), "at")
    return counted.select("at", (F.col("new") + F.col("corner") + F.col("in_part") + F.col("in_prev") - F.col("prev")).alias("others"))


def session_steps(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", ttl: int = TTL_SECONDS, capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """(tie, key, session, step): a key's counter restarts after more than ``ttl`` idle seconds, or once ``capacity`` other keys were written since."""
    rows = placed(events, key, ts, tie, parts)
    far = distances(rows)
    before = rows.select(F.col("at").alias("prev"), F.col("us").alias("prev_us"))
    rows = rows.join(before, "prev", "left").join(far, "at", "left")
    restart = F.coalesce((F.col("us") - F.col("prev_us") > ttl * 1_000_000) | (F.col("others") >= capacity), F.lit(True))
    rows = rows.select("event", "k", "part", "at", restart.alias("restart"))
    own = Window.partitionBy("part", "k").orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(own)).withColumn("sessions", F.sum(F.col("restart").cast("long")).over(own)).withColumn("began", F.max(F.when(F.col("restart"), F.col("n"))).over(own))
    rows, _ = scratch.write(rows)
    # what the parts before hold of the key: its writes, its sessions, and which write began the last one
    ends = rows.groupBy("part", "k").agg(F.max("n").alias("n"), F.max("sessions").alias("sessions"), F.max("began").alias("began"))
    ahead = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("n_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("s_ahead", F.coalesce(F.sum("sessions").over(ahead), F.lit(0)))
    ends = ends.withColumn("b_ahead", F.max(F.col("began") + F.col("n_ahead")).over(ahead)).select(F.col("part").alias("e_part"), F.col("k").alias("e_k"), "n_ahead", "s_ahead", "b_ahead")
    joined = rows.join(ends, (F.col("part") == F.col("e_part")) & F.col("k").eqNullSafe(F.col("e_k")))
    began = F.coalesce(F.col("began") + F.col("n_ahead"), F.col("b_ahead"))
    return joined.select(F.col("event").alias(tie), F.col("k").alias(key), (F.col("sessions") + F.col("s_ahead")).alias("session"), (F.col("n") + F.col("n_ahead") - began + 1).alias("step"))


def session_steps_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by user in a store with room for 40 of them."""
    return session_steps(table(spark, sf_dir, "events"), ttl=14_400, capacity=40)


QUERIES = {"session_steps_capped": session_steps_capped}
ORACLE = {
    "session_steps_capped": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), p AS (SELECT *, lag(pos) OVER w AS prev, lag(us) OVER w AS prev_us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
        d AS (SELECT i.pos, count(*) AS others FROM p i JOIN p j ON j.pos > i.prev AND j.pos < i.pos AND coalesce(j.prev, 0) < i.prev GROUP BY i.pos),
        r AS (SELECT event_id, user_id, p.pos, CASE WHEN prev IS NOT NULL AND us - prev_us <= 14400000000 AND coalesce(others, 0) < 40 THEN 0 ELSE 1 END AS restart FROM p LEFT JOIN d ON d.pos = p.pos),
        s AS (SELECT *, CAST(sum(restart) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS session FROM r)
        SELECT event_id, user_id, session, row_number() OVER (PARTITION BY user_id, session ORDER BY pos) AS step FROM s"""
}
