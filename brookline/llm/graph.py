"""Connected components of an edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the edges (u, v).

    Nodes take the smallest label among their neighbours', then their label's label, until
    nothing changes: the number of rounds grows as the logarithm of the longest path. Each
    round is a written table, so lineage stays short and a lost executor costs one round at
    most. Minima are combined before they are shuffled; a hub's edges are split by adaptive
    skew joins. Self-loops, repeated edges and nulls are dropped; no edges give no rows.
    """
    both = edges.select("u", "v").where("u <> v").dropDuplicates()
    both = scratch.keep(both.union(both.select("v", "u")).dropDuplicates(), "edges")
    label = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = both.join(label, both.v == label.node).groupBy(F.col("u").alias("at")).agg(F.min("component").alias("near"))
        low = label.join(near, label.node == near["at"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = label.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        new = scratch.keep(low.join(up, low.component == up["at"], "left").select("node", F.least("component", "jump").alias("component"), "old"), "labels")
        changed = new.where("component <> old").limit(1).count()
        scratch.drop(label)
        label = new
        if not changed:
            scratch.drop(both)
            return new.select("node", "component")
