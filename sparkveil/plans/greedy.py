"""Serial greedy choices as rounds over DataFrames, with the serial result.

``suppressed``: going through items by rank, an item is dropped if a kept one before it excludes it.  In a round every item
without an undecided excluder is kept and what it excludes is dropped; what is left goes round again.

``assigned``: going through takers by rank, each takes the dearest free item that it wants.  All takers ask at once; an item holds
the first of those who ask, and everyone behind its holder is refused for good.  The holder can only move forward, so when
nobody is refused any more the holders are the serial choices.

Every round is a few joins and pre-aggregated groupings by item, and its result a table in the shared folder: no group of
items is gathered in one task.  The number of rounds follows the longest chain of decisions, not the number of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def suppressed(edges: DataFrame) -> DataFrame:
    """(node): the items that go, of edges (hi, lo) in which ``hi`` comes first in rank and excludes ``lo``."""
    spark = edges.sparkSession
    live, path = scratch.write(edges.select("hi", "lo").distinct())
    gone_all = edges.select(F.col("lo").alias("node")).limit(0)
    while not live.isEmpty():
        kept, kept_path = scratch.write(live.select("hi").distinct().join(live.select(F.col("lo").alias("hi")), "hi", "left_anti"))
        gone, _ = scratch.write(live.join(kept, "hi", "left_semi").select(F.col("lo").alias("node")).distinct())
        rest = live.join(kept, "hi", "left_anti").join(gone.select(F.col("node").alias("hi")), "hi", "left_anti").join(gone.select(F.col("node").alias("lo")), "lo", "left_anti")
        following, new_path = scratch.write(rest.select("hi", "lo"))
        for done in (path, kept_path):
            scratch.drop(spark, done)
        live, path = following, new_path
        gone_all = gone_all.unionAll(gone)
    scratch.drop(spark, path)
    return gone_all


def assigned(wishes: DataFrame) -> DataFrame:
    """(taker, item, value) of the serial choice, of wishes (taker, rank, item, tie, value): the greatest value is dearest, then the least ``tie``.

    ``rank`` orders the takers that want a common item, and no two of them have the same.
    """
    spark = wishes.sparkSession
    live, path = scratch.write(wishes.select("taker", "rank", "item", "tie", "value"))
    n = live.count()
    while True:
        asked = live.groupBy("taker", "rank").agg(F.min_by("item", F.struct(-F.col("value"), F.col("tie"))).alias("item"))
        holders = asked.groupBy("item").agg(F.min("rank").alias("first"))
        rest = live.join(holders, "item", "left").where("first is null or rank <= first")
        following, new_path = scratch.write(rest.select("taker", "rank", "item", "tie", "value"))
        scratch.drop(spark, path)
        live, path, before = following, new_path, n
        n = live.count()
        if n == before:
            break
    best = F.min_by(F.struct("item", "value"), F.struct(-F.col("value"), F.col("tie")))
    return live.groupBy("taker").agg(best.alias("b")).select("taker", "b.item", "b.value")
