"""Distributed connected components by alternating large and small stars, in DataFrame operations only.

Each round is two joins of the links with the least neighbour of each node; a node of any degree is first reduced to that
least neighbour by a partial aggregate, and links of a node that holds a large share of all are joined where they stand
(spread_join). Rounds grow with the logarithm of the number of nodes. Each round ends in a written table in the shared
folder; what is needed to see whether it changed anything is observed while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gristmill.llm.common import delete, shared_path, spread_join

MAX_ROUNDS = 60


def _written(df: DataFrame) -> tuple[DataFrame, str, tuple[int, int]]:
    """df written and read back, its path, and its number of links and a sum over them."""
    path, seen = shared_path(df.sparkSession, "links"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("sum")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that stands in a link to another; root is the least node of its component.

    Links may repeat, point either way and join a node to itself (which links nothing); those with a null end are none.
    """
    big, small = F.greatest(a, b).alias("big"), F.least(a, b).alias("small")
    edges, path, state = _written(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big, small).distinct())
    for _ in range(MAX_ROUNDS if state[0] else 0):
        # Large star: what is above a node moves to the least node of its neighbourhood.
        both = edges.select(F.col("small").alias("of"), F.col("small").alias("least"), F.lit(1).alias("own")).unionByName(edges.select(F.col("big").alias("of"), F.col("small").alias("least"), F.lit(0).alias("own")))
        least = both.groupBy(F.col("of").alias("small")).agg(F.min("least").alias("least"), F.sum("own").alias("n"))
        large, between, count = _written(spread_join(edges, least, "small", "n", state[0]).select("big", F.col("least").alias("small")).distinct())
        # Small star: what is below a node moves to the least of them, and so does the node.
        low = large.groupBy("big").agg(F.min("small").alias("least"), F.count("*").alias("n"))
        moved = spread_join(large, low, "big", "n", count[0]).filter("small <> least").select(F.col("small").alias("big"), F.col("least").alias("small"))
        before = state
        after, new, state = _written(moved.unionByName(low.select("big", F.col("least").alias("small"))).distinct())
        for old in (path, between):
            delete(edges.sparkSession, old)
        edges, path = after, new
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    return edges.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(edges.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())
