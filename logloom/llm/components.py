"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stage


def _lowest(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min(other).alias("_low"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node with a link.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Each round hangs the larger
    neighbours of every node, then the smaller ones, on the least neighbour, until only stars are
    left; the number of rounds grows with the logarithm of the longest path. Nothing is collected;
    neighbour lists are never built, so a star of any size spreads over tasks (partial minima, and
    joins that adaptive execution may split). Each round is written to the shared folder.
    Null ends and self-links are ignored; an empty table gives an empty one.
    """
    current = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both, "a", "b").select("a", F.least("a", "_low").alias("_low"))
        large = (
            both.where("b > a").join(low, "a").where("b <> _low")
            .select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        )
        lows = _lowest(large, "a", "b")
        small = large.join(lows, "a").where("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        after = stage(small.unionByName(lows.withColumnRenamed("_low", "b")).distinct(), "links")
        state = after.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if state == before:
            break
        current, before = after, state
    else:
        raise RuntimeError(f"links did not become stars in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
