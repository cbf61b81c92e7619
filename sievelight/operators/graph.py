"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.session import materialize


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of the nodes of links(src, dst); the component is its least node.

    Label propagation with pointer jumping: every round takes the least label of the neighbours and then the label of
    the label, so rounds grow with the logarithm of the longest path. Labels of a node are pre-aggregated, links are
    never gathered per node. Loops and repeated links change nothing; an empty table has no components."""
    both = materialize(links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.src, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = materialize(step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("further", "c")).alias("component")))
        changed = new.where("old != component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
