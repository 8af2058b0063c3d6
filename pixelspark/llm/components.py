"""Connected components of a link relation, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable node for every node of ``links(a, b)``; returns ``(node, component)``.

    Every round takes the smallest label over a node's neighbours and then follows the labels
    once (pointer jumping), so a chain shrinks by a factor each round.  Labels of a round are
    written to the shared folder; a round reads the previous one and the links only.  Hubs are
    harmless: minima are pre-aggregated and both joins are plain joins which adaptive execution
    can split.  Nodes without links are not in the result; no links give no rows.
    """
    both = scratch.keep(
        links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    )
    n = both.count()  # at least one row for each node
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), n)
    while True:  # labels only fall, so this ends
        near = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        hooked = scratch.keep(labels.join(near, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before")), n)
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nxt = hooked.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "before")
        nxt = scratch.keep(nxt, n)
        changed = not nxt.where("component <> before").isEmpty()
        scratch.drop(labels, hooked)
        labels = nxt
        if not changed:
            scratch.drop(both)
            return labels.select("node", "component")
