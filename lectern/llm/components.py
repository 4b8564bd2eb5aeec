"""Connected components by alternating stars, in DataFrame operations only.

Every round is two joins of the edge list with one row per node, taken before the shuffle for each task; the edge list is cut to the shared
checkpoint folder after each, so that neither plan nor lineage grows. A hub's edges meet one row, so adaptive execution may split them over
tasks (a list of hubs of our own in each round took the driver's memory in many rounds). The number of rounds grows with
the logarithm of the longest chain, not with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node reachable.

    Null ends, self-loops and repeated edges are ignored, except that the node of a self-loop is listed. Nodes
    may be of any orderable type. An empty edge list gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    given = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(a.isNotNull() & b.isNotNull())
    alone = given.where("hi = lo").select(F.col("hi").alias("node"))
    now = cut(given.where("hi <> lo").distinct())
    state = _state(now)
    while state[0]:
        # Large star: what lies above a node goes to the least of its neighbours and itself.
        least = (
            now.select(F.col("hi").alias("at"), F.col("lo").alias("to"))
            .union(now.select(F.col("lo").alias("at"), F.col("lo").alias("to")))
            .groupBy("at")
            .agg(F.min("to").alias("least"))
        )
        large = now.withColumnRenamed("lo", "at").join(least, "at").select("hi", F.col("least").alias("lo")).distinct()
        # Small star: a node and what lies below it go to the least node below it.
        low = large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("least"))
        star = (
            large.withColumnRenamed("hi", "at")
            .join(low, "at")
            .select(F.explode(F.array("lo", "at")).alias("hi"), F.col("least").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        now = cut(star)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
    rest = alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(rest)


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
