"""Order of an agent run's events (T6): an automaton over status logs, composed over ranges of a run.

A run starts idle; a step is started, its action decided, then executed, and so on for at most ``STEPS`` steps.  It ends when it
is done, stopped or fails, or is exhausted in its last step.  Any other event is illegal, is reported with the state it came in, and
changes nothing.

The log is dealt by ranges of (session, task, time), so a long run is cut over many tasks.  A task knows the state in
which each of its runs began, but for the first, which may go on from the task before: for that run it gives the state at its end for *every* state
at its beginning.  These functions, one or two a range, are composed in order; then all ranges are read again, each
from its true state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import scratch
from ..sources import table
from .state import STEPS, TERMINAL, micros

# The order within a step.
CYCLE = ("STEP_STARTED", "ACTION_DECIDED", "ACTION_EXECUTED")
PHASES = ("IDLE", *CYCLE, "ENDED")


class Automaton:
    """States: 0 idle; then three for each step; the last one is the end."""

    def __init__(self, steps: int) -> None:
        self.steps, self.n, self.end = steps, 3 * steps + 2, 3 * steps + 1
        stay = np.arange(self.n)
        self.next: dict[str, np.ndarray] = {}
        for place, event in enumerate(CYCLE):
            # in state s > 0 the cycle stands at (s - 1) % 3; the event that follows leads one state on
            moves = ((stay - 1) % 3 == (place - 1) % 3) & (stay > 0) & (stay < self.end - (place == 0)) if place else (stay % 3 == 0) & (stay < self.end - 1)
            self.next[event] = np.where(moves, stay + 1, stay)
        for event in TERMINAL:
            ends = (stay < self.end) & ((stay > self.end - 4) if event == "TASK_EXHAUSTED" else True)
            self.next[event] = np.where(ends, self.end, stay)
        self.idle = stay

    def legal(self, state: int, event: str | None) -> bool:
        return event in self.next and self.next[event][state] != state

    def shown(self, state: int) -> tuple[str, int]:
        """Phase and steps begun; the end does not say how many there were."""
        return ("IDLE", 0) if state == 0 else ("ENDED", 0) if state == self.end else (CYCLE[(state - 1) % 3], (state - 1) // 3 + 1)


_KEYS = ("session_id", "task_id")


def transitions(log: DataFrame, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Illegal events (session_id, task_id, ts, ord, event, phase, step) and runs (session_id, task_id, events, illegal, phase, step).

    ``log``: session_id, task_id, ts, ord, event; a null in a key is a key.  ``step`` counts the steps begun before the event, or at the run's last
    event before its end.
    """
    types = dict(log.dtypes)
    order = [*_KEYS, "ts", "ord"]
    rows, _ = scratch.write(log.select(*order, "event").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    dealt = rows.repartition("part").sortWithinPartitions("part", *order)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, last, same, targets): the first run of a part as a function, and its last run's state, if that is another run."""
        automaton = Automaton(steps)
        part = key = None
        made: list[list] = []  # function of the first run; state of the current one

        def done() -> pa.RecordBatch:
            out = [(part, 0, *map(repr, made[0][0]), made[0][1].tolist())]
            if len(made) > 1:
                out.append((part, 1, *map(repr, made[1][0]), made[1][1].tolist()))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())), strict=True)], names=["part", "last", "session", "task", "targets"])

        for batch in batches:
            for p, event, *own in zip(*(batch.column(c).to_pylist() for c in ("part", "event", *_KEYS)), strict=True):
                if p != part:
                    if made:
                        yield done()
                    part, key, made = p, own, [[own, automaton.idle]]
                elif own != key:
                    key = own
                    made[1:] = [[own, automaton.idle[:1]]]
                step = automaton.next.get(event)
                if step is not None:
                    made[-1][1] = step[made[-1][1]]
        if made:
            yield done()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, start): the state in which each part's first run goes on."""
        before, state = None, 0
        for batch in batches:
            starts = []
            for part, last, session, task, targets in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not last:
                    start = state if before == (session, task) else 0
                    starts.append((part, start))
                    state = targets[start]
                else:
                    state = targets[0]
                before = (session, task)
            yield pa.record_batch([pa.array([s[k] for s in starts], pa.int32()) for k in range(2)], names=["part", "start"])

    found = dealt.select("part", "event", *_KEYS).mapInArrow(ends, "part int, last int, session string, task string, targets array<int>")
    # one or two rows a range of the log
    starts, _ = scratch.write(found.repartition(1).sortWithinPartitions("part", "last").mapInArrow(chain, "part int, start int"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, part, key, state, began = Automaton(steps), None, None, 0, 0
        for batch in batches:
            phases, counts, bad = [], [], []
            for p, start, event, *own in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "event", *_KEYS)), strict=True):
                if p != part or own != key:
                    state = start if p != part else 0
                    part, key = p, own
                before, legal = state, automaton.legal(state, event)
                if legal:
                    state = int(automaton.next[event][state])
                phase, begun = automaton.shown(state if legal else before)
                phases.append(phase)
                counts.append(begun)
                bad.append(not legal)
            columns = [*(batch.column(c) for c in ("part", *order, "event")), pa.array(phases), pa.array(counts, pa.int32()), pa.array(bad)]
            yield pa.record_batch(columns, names=["part", *order, "event", "phase", "step", "illegal"])

    fields = ", ".join(["part int", *(f"{c} {types[c]}" for c in order), "event string", "phase string", "step int", "illegal boolean"])
    seen, _ = scratch.write(dealt.join(F.broadcast(starts), "part").sortWithinPartitions("part", *order).mapInArrow(judged, fields))
    illegal = seen.where("illegal").select(*order, "event", "phase", "step")
    at = F.struct("part", "ts", "ord")
    runs = seen.groupBy(*_KEYS).agg(F.count("*").alias("events"), F.count_if("illegal").alias("illegal"), F.max_by("phase", at).alias("phase"), F.max("step").alias("step"))
    return illegal, runs


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs: a session a user, a task a week; events in order but for one in seventeen."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.floor(micros("ts") / 604_800_000_000).alias("task_id"), "ts", F.col("event_id").alias("ord"))
    k = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("ts", "ord")) - 1
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    event = F.when(F.col("ord") % 17 == 0, pick((*CYCLE, "NOTE"), F.col("ord"))).when((F.col("ord") % 23 == 0) & (k > 20), pick(TERMINAL, F.col("ord"))).otherwise(pick(CYCLE, k))
    return rows.withColumn("event", event)


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(_log(spark, sf_dir))[0].select(*_KEYS, "ord", "event", "phase", "step")


def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(_log(spark, sf_dir))[1]


QUERIES = {"illegal_transitions": illegal_transitions, "run_order": run_order}
_WALK = f"""RECURSIVE w AS (SELECT user_id AS session_id, CAST(floor(epoch_us(ts) / 604800000000.0) AS BIGINT) AS task_id, ts, event_id AS ord FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, task_id ORDER BY ts, ord) - 1 AS k FROM w),
    l AS (SELECT *, CASE WHEN ord % 17 = 0 THEN {[*CYCLE, 'NOTE']}[ord % 4 + 1] WHEN ord % 23 = 0 AND k > 20 THEN {list(TERMINAL)}[ord % 4 + 1] ELSE {list(CYCLE)}[k % 3 + 1] END AS event FROM r),
    s AS (SELECT session_id, task_id, CAST(-1 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS ord, '' AS event, 'IDLE' AS phase, 0 AS step, false AS illegal FROM (SELECT DISTINCT session_id, task_id FROM l)
        UNION ALL SELECT session_id, task_id, k, ord, event, CASE WHEN NOT ok THEN phase WHEN event IN {TERMINAL} THEN 'ENDED' ELSE event END, CASE WHEN NOT ok THEN step WHEN event IN {TERMINAL} THEN 0 WHEN event = 'STEP_STARTED' THEN step + 1 ELSE step END, NOT ok
        FROM (SELECT l.session_id, l.task_id, l.k, l.ord, l.event, s.phase, s.step, CASE WHEN l.event = 'STEP_STARTED' THEN s.phase IN ('IDLE', 'ACTION_EXECUTED') AND s.step < {STEPS} WHEN l.event = 'ACTION_DECIDED' THEN s.phase = 'STEP_STARTED'
            WHEN l.event = 'ACTION_EXECUTED' THEN s.phase = 'ACTION_DECIDED' WHEN l.event = 'TASK_EXHAUSTED' THEN s.phase <> 'ENDED' AND s.step = {STEPS} WHEN l.event IN {TERMINAL} THEN s.phase <> 'ENDED' ELSE false END AS ok
            FROM s JOIN l ON l.session_id = s.session_id AND l.task_id = s.task_id AND l.k = s.k + 1))"""
ORACLE = {
    "illegal_transitions": f"WITH {_WALK} SELECT session_id, task_id, ord, event, phase, step FROM s WHERE illegal",
    "run_order": f"WITH {_WALK} SELECT session_id, task_id, count(*) AS events, count(*) FILTER (illegal) AS illegal, arg_max(phase, k) AS phase, max(step) AS step FROM s WHERE k >= 0 GROUP BY 1, 2",
}
