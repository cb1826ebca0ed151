"""Connected components of a graph given by its links, with bounded work per round.

Large-star and small-star rounds (each a grouped minimum and a join) until nothing
changes; the links of every round are written to the shared folder, so lineage stays short
and a lost executor costs one round at most. Nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def _smallest(rows: DataFrame, least_of: Column) -> DataFrame:
    """Rows (node, other) with the smallest of a node's others, itself included, attached."""
    least = rows.groupBy("node").agg(F.min(least_of).alias("least"))
    return rows.join(least, "node")


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("other").alias("node"),
                                          F.col("node").alias("other")))
    linked = _smallest(both, F.least("node", "other")).filter("other > node")
    return linked.select(F.col("other").alias("node"), F.col("least").alias("other"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("node", "other").alias("node"),
                        F.least("node", "other").alias("other"))
    linked = _smallest(down, F.col("other"))
    moved = linked.filter("other != least").select(F.col("other").alias("node"),
                                                   F.col("least").alias("other"))
    kept = linked.select("node", F.col("least").alias("other"))
    return moved.unionByName(kept)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node of its component.

    ``links`` has the columns node and other, of one comparable type; links of a node to
    itself and repeated links are allowed. A round is the last when it gives the links it
    was given: then every node hangs on its root.
    """
    now = written(links.select("node", "other").filter("node != other").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))
                     ).first()
        return tuple(row)

    seen = state(now)
    while True:
        now = written(_small_star(_large_star(now).distinct()).distinct(), "links")
        after = state(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct()
    return now.select("node", F.col("other").alias("root")).unionByName(roots)
