"""Connected components as a distributed loop; nothing of the graph goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import free, stash


def components(links: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of each node in the links (a, b).

    Each round every node takes the smallest root among its neighbours and then that root's root, so that
    rounds grow with the logarithm of a component's diameter in practice.  Rounds are stored, not chained.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stash(both.filter("a <> b").distinct(), "links")
    now = stash(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        near = now.select(F.col("node").alias("b"), "root")
        seen = both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = now.join(seen, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("root").alias("top"))
        best = F.coalesce("top", "low")
        moved = least.join(jump, "low", "left").select(
            "node", best.alias("root"), (best != F.col("root")).alias("moved")
        )
        new = stash(moved, "roots")
        free(now)
        now = new
        if new.filter("moved").isEmpty():
            free(both)
            return new.select("node", "root")
