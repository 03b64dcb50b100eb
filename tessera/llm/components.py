"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; nodes share a root exactly
    when links connect them. The root is some node of the component.

    Each round every node points at the neighbour (or itself) of least hash, and
    the graph is contracted along the pointers. Hashes make the order random, so
    chains shrink by a constant factor a round. A hub meets its neighbours only
    in a pre-aggregated minimum and in joins against a one-row-per-node table,
    which adaptive execution splits. Each round's tables are in the shared folder.
    Null or equal ends are no link. No link: no row.
    """
    edge = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edge = stored(edge.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    assigned = None
    while not edge.isEmpty():
        both = edge.union(edge.select(F.col("b"), F.col("a")))
        first = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("first")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        point = both.groupBy("a").agg(first).select(F.col("a").alias("node"), F.least("first", own)["n"].alias("root"))
        point = stored(point, "pointers")
        if assigned is None:
            assigned = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            assigned = stored(assigned.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        for end in ("a", "b"):
            edge = edge.join(point.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        edge = edge.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edge = stored(edge, "edges")
    if assigned is None:
        assigned = edge.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return assigned
