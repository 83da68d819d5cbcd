"""Classes of linked nodes, by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.operators import skew
from weirmill.session import stored

#: A class joined by a chain longer than 2 ** MAX_ROUNDS hops would be left split; an error is raised instead.
MAX_ROUNDS = 40


def linked_classes(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node over the links ``edges`` (src, dst), in both directions.

    Links with a null end and from a node to itself are left out. A round takes the least label of each node's neighbours (combined
    before the shuffle; if there are nodes of more than skew.HEAVY links, the labels of the most linked ones come by a bounded
    broadcast), then jumps to the label's own label. Each round's labels are written to the shared folder, so the plan stays short
    and a lost executor costs one round at most.
    """
    ends = F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    links = stored(edges.filter("src <> dst").select(ends).distinct(), "links")
    labels = stored(links.groupBy("node").agg(F.least("node", F.min("other")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
    heavy = labels.filter(F.col("n") > skew.HEAVY)
    hot = None if heavy.isEmpty() else stored(heavy.orderBy(F.desc("n"), "node").limit(skew.MAX_HOT).select(F.col("node").alias("other")), "hot")
    for _ in range(MAX_ROUNDS):
        near = labels.select(F.col("node").alias("other"), "label")
        met = links.join(near, "other") if hot is None else skew.lookup_join(links, near, ["other"], near.join(F.broadcast(hot), "other", "left_semi"))
        least = met.groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(least, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = stored(step.join(jump, "near", "left").select("node", F.least("near", "far").alias("label"), "before"), "labels")
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels
    raise RuntimeError("labels still change; raise MAX_ROUNDS")
