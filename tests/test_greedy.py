"""Greedy choices in rounds: equal to the serial ones."""

import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import metrics, regions
from sparkveil.plans import greedy

SCHEMA = "page long, ord long, x long, y long, w long, h long, cls string, pct long"


def page(rng, p, n, side):
    return [(p, k, rng.randint(0, side), rng.randint(0, side), rng.randint(5, 30), rng.randint(5, 30), rng.choice("ab"), rng.choice([50, 60, 70, 80])) for k in range(n)]


def test_suppression_in_rounds_is_the_serial_one(spark):
    rng = random.Random(1)
    rows = [r for p, n, side in ((1, 300, 120), (2, 2, 5), (3, 80, 30), (4, 1, 1)) for r in page(rng, p, n, side)] + [(5, k, 3 * k, 0, 10, 10, "a", 100 - k) for k in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    folded, rounds, both = (sorted(tuple(r) for r in regions.nms(frame, 0.3, by, most).collect()) for by, most in ((("page", "cls"), 10**9), (("page", "cls"), 0), (("page", "cls"), 40)))
    assert folded == rounds == both and 60 < len(folded) < len(rows) - 60


def test_a_chain_of_suppressions(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(0, 1), (20, 21)], "hi int, lo int")
    assert sorted(r.node for r in greedy.suppressed(edges).collect()) == [1, 3, 5, 7, 9, 21]
    assert greedy.suppressed(edges.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.1, 0.3])
def test_assignment_in_rounds_is_the_serial_one(spark, least):
    rng = random.Random(2)
    truth, found = ([r for p, n, side in ((1, 150, 90), (2, 2, 5), (3, 40, 20), (4, k, 9)) for r in page(rng, p, n, side)] for k in (1, 2))
    truth, found = spark.createDataFrame(truth, SCHEMA), spark.createDataFrame(found, SCHEMA)
    serial, rounds, both = (sorted(map(repr, (tuple(r[c] for c in ("page", "ord", "cls", "pct", "hit")) + (r.iou and round(r.iou, 9),) for r in metrics.assign(truth, found, least, most).collect()))) for most in (10**9, 0, 100))
    assert serial == rounds == both and sum("True" in r for r in serial) > 50


def test_assignment_prefers_the_first_taker(spark):
    wishes = spark.createDataFrame([("a", 1, "x", 1, 0.5), ("b", 2, "x", 1, 0.9), ("b", 2, "y", 2, 0.4), ("c", 3, "y", 2, 0.9), ("d", 4, "z", 3, 0.5), ("d", 4, "w", 4, 0.5)], "taker string, rank int, item string, tie int, value double")
    got = {r.taker: r.item for r in greedy.assigned(wishes).collect()}
    assert got == {"a": "x", "b": "y", "d": "z"}
    assert greedy.assigned(wishes.limit(0)).count() == 0


def test_a_hub_is_no_task(spark):
    """A box over 3,000 small ones: edges are grouped by item, and the result is the serial one."""
    rows = [(1, 0, 0, 0, 1000, 1000, "a", 99)] + [(1, k + 1, 10 * (k % 60), 10 * (k // 60), 10, 10, "a", 50) for k in range(3_000)]
    kept = regions.nms(spark.createDataFrame(rows, SCHEMA), 0.00005)
    assert kept.agg(F.count("*"), F.min("ord")).first() == (1, 0)
