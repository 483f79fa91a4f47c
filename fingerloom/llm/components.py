"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.session import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links ``a``, ``b``; the root is the component's least node.

    Each round is written to the shared folder, so a lost executor costs one round. The number of rounds grows with the
    logarithm of a component's diameter; only counts reach the driver.
    """
    current, before = materialized(edges.select("a", "b").where("a != b").distinct(), "links"), None
    while True:
        current = materialized(_small_star(_large_star(current)), "links")
        # A star forest is a fixed point: compare an order-free digest of the links.
        digest = tuple(current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if digest == before:
            break
        before = digest
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
