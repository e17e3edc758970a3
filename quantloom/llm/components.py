"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, hot_join, stored


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, component) for each node of links (a, b): component is the smallest node it reaches.

    Labels spread along links and jump to their label's label until none changes,
    so that the rounds needed grow with the logarithm of a component's width in
    practice, a chain in the order of its ids included.  Each round but the last
    lowers a label, so that the rounds end.  Without links, and without start, the result is
    empty; null ends and links of a node with itself are left out.  The result is a stored table.  start may give components found
    earlier; its nodes stay in the result, and stay together.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    both = stored(links.union(links.select("b", "a")))
    nodes = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("links")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"), "links")
    if start is not None:
        # an earlier label goes before a link's: it is what moves the rest of its component along
        earlier = start.groupBy("node").agg(F.min("component").alias("earlier"))
        nodes = nodes.join(earlier, "node", "full").select("node", F.coalesce("earlier", "component").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    labels = stored(nodes)
    n_both, n_labels = both.count(), labels.count()
    while True:
        # hubs, and labels that many carry, do not meet in one task
        seen = hot_join(both, labels.select(F.col("node").alias("b"), "component", F.col("links").alias("rows")), "b", "component", n_both).groupBy("a").agg(F.min("component").alias("seen"))
        low = labels.join(seen, labels["node"] == seen["a"], "left").select("node", "links", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("component"))
        low = stored(low)
        # a label that moved takes along all that carry it
        moved = low.groupBy("old").agg(F.min(F.when(F.col("component") < F.col("old"), F.col("component"))).alias("to"), F.count("*").alias("rows")).where("to is not null")
        lower = hot_join(low, moved, "old", "to", n_labels).select("node", "links", "old", F.least("component", F.coalesce("to", "component")).alias("component"))
        before, low = low, stored(lower)
        discard(labels, before)
        if low.where("component < old").isEmpty():
            discard(both)
            found = low.select("node", "component")
            found._stored_at = low._stored_at
            return found
        carried = low.groupBy("component").agg(F.count("*").alias("rows"))
        jump = low.where("component < node").select(F.col("node").alias("via"), F.col("component").alias("further")).join(carried, F.col("via") == F.col("component")).select("component", "further", "rows")
        labels = stored(hot_join(low.select("node", "links", "component"), jump, "component", "further", n_labels).select("node", F.coalesce("further", "component").alias("component"), "links"))
        discard(low)
