"""Connected components of an edge table: union-find as alternating star contractions.

Each half step joins edges with the least neighbour of their node and is written to the shared
folder; no step gathers the neighbours of a node (a join with a written table has plain shuffles on
both sides, so a hot node can be split), and the driver sees one row of totals. The joins are by merging: the files
of such a table are so compressed that their size says little, and Spark would broadcast what it takes for small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) from (u, v): the least node that each node with an edge reaches; roots have no row."""
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(both, "stars"), None
    while True:
        # large star: neighbours above a node move to its least neighbour
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = sides.join(least.hint("merge"), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "stars")
        # small star: a node and its neighbours below it move to the least of these
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state
