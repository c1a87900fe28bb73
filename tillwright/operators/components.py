"""Connected components of an edge table, in a logarithmic number of rounds.

Every round each node joins the neighbour (or itself) with the smallest hash,
and the edges between the joined nodes are the next round's graph.  Hash order
makes the expected number of nodes fall by a constant factor a round whatever
the shape of the graph (a long chain included); nothing is collected, hot
nodes are pre-aggregated, and every round cuts lineage with a written table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str, b: str, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``node``, ``root`` for every node of the edges; equal roots are one component.

    ``write`` stores a table in the cluster's shared folder and reads it back.
    ``edges`` should be a written table itself, as it is read several times; rows
    with a null end are ignored.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("n"))
    graph = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    found = None
    while True:
        both = graph.select("u", "v").union(graph.select(F.col("v"), F.col("u")))
        joined = write(both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
                       .select("u", F.least(F.col("m"), rank(F.col("u")))["n"].alias("to")), "joined")
        if found is None:
            found = joined.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:  # a join of written tables, one a round
            nxt = joined.select(F.col("u").alias("root"), "to")
            found = found.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        left, right = (joined.select(F.col("u").alias(x), F.col("to").alias(y)) for x, y in (("u", "x"), ("v", "y")))
        graph = write(graph.join(left, "u").join(right, "v").filter("x <> y")
                      .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        if graph.isEmpty():
            return write(found, "roots")
