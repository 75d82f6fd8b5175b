"""Pairs of boxes in crowded cells: the same as those of a plain sweep."""

import random

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import geometry as G
from sparkveil.operators import regions as R


def sweep(rows):
    """Overlapping pairs (page, a, b) by a sweep over x."""
    found, open_ = set(), []
    for p, k, x, y, w, h in sorted(rows, key=lambda r: (r[0], r[2])):
        open_ = [o for o in open_ if o[0] == p and o[2] + o[4] > x]
        found |= {(p, min(k, o[1]), max(k, o[1])) for o in open_ if o[3] < y + h and y < o[3] + o[5]}
        open_.append((p, k, x, y, w, h))
    return found


@pytest.mark.parametrize(("n", "side", "sizes"), [(4_000, 200, (2, 6)), (1_500, 60, (1, 40)), (3_000, 128, (1, 3)), (400, 10, (1, 2)), (900, 2_000, (1, 300))])
def test_pairs_of_a_crowded_page(spark, n, side, sizes):
    rng = random.Random(n)
    rows = [(p, k, rng.randrange(-side, side), rng.randrange(-side, side), rng.randint(*sizes), rng.randint(*sizes)) for p, m in ((1, n), (2, 30)) for k in range(m)]
    rows += [(1, n + k, -side, -side + k, 2 * side, 1) for k in range(5)]  # a few across the whole page
    frame = spark.createDataFrame(rows, "page long, ord long, x long, y long, w long, h long")
    got = R.pairs(frame).where(G.overlap(R.xywh("a_"), R.xywh("b_")) > 0).select("page", "a_ord", "b_ord").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == sweep(rows)


def test_crowded_cells_make_fewer_candidates(spark):
    """A page of 50,000 small boxes on 500 by 500: candidates grow with the pairs that overlap, not with the square of a cell's boxes."""
    rng = random.Random(7)
    frame = spark.createDataFrame([(1, k, rng.randrange(500), rng.randrange(500), 2, 2) for k in range(50_000)], "page long, ord long, x long, y long, w long, h long")
    listed = R.cells(frame).groupBy("cx", "cy").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    made = R.pairs(frame)
    assert made.where(G.overlap(R.xywh("a_"), R.xywh("b_")) > 0).count() > 30_000
    assert made.count() < listed / 10
