"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges (src, dst).

    Alternating star operations: each node links its larger neighbours, then its
    smaller ones, to its smallest neighbour, until nothing moves, as the graph is a set of
    stars. A round shuffles the edges twice, by either end. The number of rounds grows with
    the logarithm of the longest path. Rows with a null end are left out; loops and repeated
    edges do no harm. A graph that ``rounds`` don't finish raises.
    """
    clean = edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).where("s is not null and d is not null")
    # Loops are stored with the edges, so that what the edges come from is worked out once.
    stored = checkpointed(clean.select(F.greatest("s", "d").alias("x"), F.least("s", "d").alias("y")).distinct())
    loops = stored.where("x = y").toDF("node", "component")
    now = stored.where("x <> y")
    ends = lambda *pairs: F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))
    of_u, of_x = Window.partitionBy("u"), Window.partitionBy("x")
    for _ in range(rounds):
        both = now.select(ends("xy", "yx")).withColumn("m", F.min("v").over(of_u))
        large = both.where("v > u").select(F.col("v").alias("x"), F.least("u", "m").alias("y"), (F.col("m") < F.col("u")).alias("moved"))
        # Dealt by x first: the edges of a node meet once, to be made distinct and to find the smallest.
        each = large.repartition("x").groupBy("x", "y").agg(F.max("moved").alias("moved")).withColumn("m", F.min("y").over(of_x)).withColumn("high", F.max("y").over(of_x))
        now = checkpointed(each.select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"), (F.col("moved") | (F.col("m") < F.col("high"))).alias("moved")))
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    members = now.select(ends("xy", "yy")).toDF("node", "component")
    return members.union(loops).groupBy("node").agg(F.min("component").alias("component"))
