"""The capped store against a replay with an ordered dictionary."""

import random
from collections import OrderedDict

import numpy as np
import pytest

from sparkveil.operators import capacity


def replay(writes, ttl, room):
    """(event, key, session, step) of writes (event, key, microseconds), in order of time."""
    store, sessions, out = OrderedDict(), {}, []
    for event, key, us in sorted(writes, key=lambda w: (w[2], w[0])):
        for k in [k for k, (_, last) in store.items() if us - last > ttl * 1_000_000]:
            del store[k]
        step = store.pop(key, (0, 0))[0] + 1
        sessions[key] = sessions.get(key, 0) + (step == 1)
        store[key] = (step, us)
        while len(store) > room:
            store.popitem(last=False)
        out.append((event, key, sessions[key], step))
    return sorted(out, key=str)


def test_smaller_before():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 64, 257):
        values = rng.permutation(n * 3)[:n]
        assert capacity.smaller_before(values).tolist() == [int((values[:k] < values[k]).sum()) for k in range(n)]


@pytest.mark.parametrize(("keys", "room", "ttl", "parts"), [(30, 5, 10**6, 4), (30, 12, 40, 7), (8, 100, 10**6, 3), (200, 150, 500, 1), (30, 1, 10**6, 16)])
def test_capped_steps_against_a_replay(spark, keys, room, ttl, parts):
    """One key has a third of all writes; keys, times and orders tie."""
    rng = random.Random(keys + room)
    writes = [(k, None if rng.random() < 0.02 else 0 if rng.random() < 0.33 else rng.randrange(keys), rng.randrange(900) * 1_000_000) for k in range(1_500)]
    frame = spark.createDataFrame(writes, "event_id long, user_id long, us long").selectExpr("event_id", "user_id", "timestamp_micros(us) AS ts", "1 AS part", "'x' AS k")
    got = capacity.session_steps(frame, ttl=ttl, capacity=room, parts=parts).collect()
    assert sorted((tuple(r) for r in got), key=str) == replay(writes, ttl, room)


def test_no_writes(spark):
    frame = spark.createDataFrame([], "event_id long, user_id long, ts timestamp")
    assert capacity.session_steps(frame).count() == 0
