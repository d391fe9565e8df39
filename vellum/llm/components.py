"""Connected components of an edge table, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that is reachable.

    Each round takes the least label among a node's neighbours, hooks the label's own node onto it
    and halves the way to the root; the rounds grow with the logarithm of the longest path. Labels
    are written to the shared folder after each round. No edges: an empty table.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = materialize(both.where("u <> v").distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        seen = labels.join(near.withColumnRenamed("u", "node"), "node")
        hooks = seen.where("near < root").groupBy("root").agg(F.min("near").alias("hook"))
        hooked = seen.join(hooks, "root", "left").select("node", F.col("root").alias("was"), F.least("root", "near", "hook").alias("root"))
        ends = labels.select(F.col("node").alias("root"), F.col("root").alias("end"))
        labels = materialize(hooked.join(ends, "root", "left").select("node", "was", F.least("root", "end").alias("root")), "labels")
        if labels.where("root <> was").limit(1).count() == 0:
            return labels.select("node", "root")
