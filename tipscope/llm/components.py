"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.llm.base import stored

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and
    its neighbours."""
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    pulled = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pulled.unionAll(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another node; the
    component is its smallest node. Rows with a NULL end and loops are ignored;
    repeated edges count once; no edges give no rows.

    Alternating large-star and small-star steps [Kiveris et al. 2014]: the edge
    table never grows, each step is two shuffles with map-side minima, and the
    loop ends when every node points at its component's smallest node.
    """
    e = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a > b").distinct())
    e = stored(e, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        e = stored(_small_star(_large_star(e)), "edges")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
