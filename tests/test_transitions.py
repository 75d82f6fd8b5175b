"""Runs against a serial walk, one of them over most ranges of the log."""

import random

from sparkveil.operators import transitions as T


def walk(events, steps):
    """(index, phase, step) of illegal events, the last phase and the most steps."""
    phase, n, bad, most = "IDLE", 0, [], 0
    for k, e in enumerate(events):
        ok = {"STEP_STARTED": phase in ("IDLE", "ACTION_EXECUTED") and n < steps, "ACTION_DECIDED": phase == "STEP_STARTED", "ACTION_EXECUTED": phase == "ACTION_DECIDED", "TASK_EXHAUSTED": phase != "ENDED" and n == steps}.get(e, e in T.TERMINAL and phase != "ENDED")
        if not ok:
            bad.append((k, phase, n))
        elif e in T.TERMINAL:
            phase, n = "ENDED", 0
        else:
            phase, n = e, n + (e == "STEP_STARTED")
        most = max(most, n)
    return bad, phase, most


def test_runs_against_a_serial_walk(spark):
    rng = random.Random(6)
    log, want_bad, want_runs = [], [], []
    for run, size in [((1, 1), 900), ((1, 2), 1), ((2, None), 40), ((None, 3), 25), ((3, 3), 400), *(((4, k), rng.randint(1, 30)) for k in range(60))]:
        events = [rng.choice([*T.CYCLE, "NOTE", None]) if rng.random() < 0.2 else T.TERMINAL[k % 4] if rng.random() < 0.01 else T.CYCLE[k % 3] for k in range(size)]
        log += [(*run, 10 * k // 7, k, e) for k, e in enumerate(events)]
        bad, phase, most = walk(events, 10)
        want_bad += [(*run, k, events[k], p, n) for k, p, n in bad]
        want_runs.append((*run, size, len(bad), phase, most))
    rng.shuffle(log)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        illegal, runs = T.transitions(spark.createDataFrame(log, "session_id long, task_id long, ts long, ord long, event string"))
        assert sorted(map(repr, (tuple(r[c] for c in ("session_id", "task_id", "ord", "event", "phase", "step")) for r in illegal.collect()))) == sorted(map(repr, want_bad))
        assert sorted(map(repr, map(tuple, runs.collect()))) == sorted(map(repr, want_runs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_log(spark):
    illegal, runs = T.transitions(spark.createDataFrame([], "session_id long, task_id long, ts long, ord long, event string"))
    assert illegal.count() == runs.count() == 0


def test_states():
    a = T.Automaton(2)
    assert [a.shown(s) for s in range(a.n)] == [("IDLE", 0), *((e, k) for k in (1, 2) for e in T.CYCLE), ("ENDED", 0)]
    assert [s for s in range(a.n) if a.legal(s, "STEP_STARTED")] == [0, 3] and [s for s in range(a.n) if a.legal(s, "ACTION_DECIDED")] == [1, 4] and [s for s in range(a.n) if a.legal(s, "ACTION_EXECUTED")] == [2, 5]
    assert [s for s in range(a.n) if a.legal(s, "TASK_EXHAUSTED")] == [4, 5, 6] and not a.legal(a.end, "TASK_DONE") and not a.legal(0, "NOTE")
