"""Connected components of links between numbered nodes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripwright.llm.common import by_shuffle
from tripwright.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the same in a component.

    Every node hooks to its smallest neighbour if that is smaller, roots are followed once
    more, and the graph is contracted to what differs. Each round at least halves the nodes
    that still have links; every round is written, so no lineage builds up and lost
    executors cost one round at most.
    """
    def contracted(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    labels, edges = None, contracted(edges)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "hooks")
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        hooked = materialize(hooked.join(by_shuffle(above), "root").select("node", F.col("top").alias("root")), "roots")
        if labels is None:
            labels = hooked
        else:
            later = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = materialize(labels.join(by_shuffle(later), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        ends = {end: by_shuffle(hooked.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))) for end in ("a", "b")}
        edges = contracted(edges.join(ends["a"], "a").join(ends["b"], "b").select(
            F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
