"""Connected components over long node ids, as joins; used by the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import drop_written, materialize, written


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    A node's label is a smaller node of its component, its parent.  Every round takes the smallest grandparent among
    neighbours, gives it to the node and to the node's parent (so whole trees are hooked, not only single nodes) and jumps
    to the own grandparent.  Rounds go on until no label changes; labels only fall, so they end.  Random chains take a few
    rounds more for each doubling.  ``rows`` bounds the number of edges in both
    directions where it is known.  Rounds are written to the shared folder; only the number of changed labels reaches the driver.
    """
    both = materialize(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "links", rows)
    rows = both.count()
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", rows)
    while True:
        before = written() - 1  # where the labels are; the round's other tables go with them
        parent = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = materialize(labels.join(parent, labels.label == parent.via).select("node", "label", "far"), "jumped", rows)
        near = both.join(jumped.select("node", "far"), both.b == jumped.node).groupBy("a").agg(F.min("far").alias("near"))
        grown = materialize(jumped.join(near, jumped.node == near.a).select("node", "label", F.least("far", "near").alias("new")), "grown", rows)
        hooks = grown.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("hook"))
        after = materialize(grown.join(hooks, grown.node == hooks.root, "left").select("node", F.least("new", F.coalesce("hook", "new")).alias("label"), F.col("label").alias("old")), "labels", rows)
        changed = after.where("label <> old").count()
        labels = after.select("node", "label")
        drop_written(both.sparkSession, before, keep=1)
        if not changed:
            return labels
