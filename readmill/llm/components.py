"""Connected components of a graph given as edges, by large-star and small-star steps.

Each step keeps the components and shortens the paths to their least node; a node's neighbours are never gathered, only their
minimum is aggregated and joined back. Steps end when the edges no longer change. Every step is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.llm.common import forget, written


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node, component (its least node) of each node that has an edge to another. edges: a, b (long)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_steps):
        # large star: the neighbours above a node go to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: a node's lower neighbours, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        new = written(small.where("a <> b").distinct(), "edges")
        forget(now)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {most_steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
