"""Connected components of an undirected graph, as DataFrame operations only.

Alternates large-star and small-star contractions until the edge set no longer
changes; every edge set is a table in the shared folder.  A round costs a few
shuffles of the edges, the number of rounds grows with the logarithm of the
longest path, and no vertex's neighbours are ever gathered in one row: the
minimum of a neighbourhood is a pre-aggregated ``min`` that is joined back, so a
hub with a third of all edges is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(pairs: DataFrame, own: bool) -> DataFrame:
    """Link each neighbour ``v`` of ``u`` to the least vertex of ``u``'s neighbourhood.

    own: also link ``u`` itself (small star); else only the neighbours above ``u``.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if own:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        linked = linked.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, component): the least vertex that each vertex of an edge can reach.

    ``edges`` has two columns of one orderable type; direction, repeats, loops and
    null ends do not matter.  Vertices without an edge to another vertex are not
    returned.  An empty edge set gives an empty result.
    """
    spark = edges.sparkSession
    flat = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    current, path = scratch.write(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == sign:
            break
        sign = (seen.n, seen.h)
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, own=False)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        following, new_path = scratch.write(_star(down, own=True))
        scratch.drop(spark, path)
        current, path = following, new_path
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
