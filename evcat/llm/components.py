"""Connected components of a link table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evcat.session import cut


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes of ``links`` (a, b): root is the smallest node that can be reached.

    Each step hangs neighbours to the smallest neighbour known (public method: large-star / small-star); rows are joined and
    aggregated, no neighbour list is collected. Ends when a step changes nothing, after a number of rounds
    logarithmic in the size of the largest component. Loops are ignored, an empty table gives no rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", "least"))
        edges = cut(hung.filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now
