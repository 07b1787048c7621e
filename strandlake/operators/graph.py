"""Connected components of large graphs, by alternating large and small stars.

Every round is a few joins and minima over the edge table, which is written to the shared folder; no
edge is ever gathered on the driver, and a node of any degree is only met by partial minima and by
joins that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import staged


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (u > v) are stars: a node that points at another has no other edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 0 and n > 1").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point at the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (``u``, ``v``: long) -> (``node``, ``root``): the least node of its component, for every
    node that has an edge and isn't its root."""
    now = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = staged(_small(_large(now)).distinct(), "edges")
    raise RuntimeError("components did not settle")
