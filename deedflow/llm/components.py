"""Connected components of a link table, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60
#: Nodes with more than one in so many of all edges (and with more than HUB_EDGES) are hubs: their least neighbours are
#: broadcast, at most so many rows, and their edges stay where they are.
HUBS = 1000
HUB_EDGES = 1000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(both: DataFrame, n: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours v.  both has at most n rows."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    hub = F.col("degree") > max(HUB_EDGES, n // HUBS)
    known = both.join(F.broadcast(least.filter(hub).select("u", "m")), "u", "left")
    others = known.filter("m IS NULL").select("u", "v").join(least.filter(~hub).select("u", "m"), "u")
    return known.filter("m IS NOT NULL").unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that links name; root is the least node of its component.  links: (u, v), any order."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges)
    state = _digest(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        downward = materialize(large)
        small = _with_least(downward, 2 * state[0])
        edges = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        old, state = state, _digest(edges)
        if old == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
