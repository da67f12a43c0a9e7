"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise, merged


def _fingerprint(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the least node of the component.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the edges stay as
    they are; the number of rounds grows with the logarithm of the largest component. Edges with a null end are
    left out; a node whose only edge leads to itself is a component of its own. Only a count and a checksum reach the driver; no side of a join is broadcast.
    Components that aren't settled after ``max_rounds`` rounds, far beyond any logarithm, are an error.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    alone = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    now = materialise(pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = _fingerprint(now)
        if mark == before:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(merged(least), "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return alone.join(merged(now.select(F.col("u").alias("node"), F.col("v").alias("least"))), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
