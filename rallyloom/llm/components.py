"""Connected components of a link table, by hooking to smaller neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyloom.llm.common import materialise


def _jump(parents: DataFrame) -> DataFrame:
    """``node, parent`` with every parent a root. Chains halve with each round."""
    while True:
        up = parents.select(F.col("node").alias("_mid"), F.col("parent").alias("_top"))
        parents = materialise(
            parents.join(up, F.col("parent") == F.col("_mid"), "left").select(
                "node", F.coalesce("_top", "parent").alias("parent"), F.col("_top").isNotNull().alias("moved")
            ),
            "jump",
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def _relabelled(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return df.join(up, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, longs); the root is the component's smallest node.

    Every round each node hooks to its smallest neighbour below it, trees are
    flattened, and links inside a tree vanish. Only tables are written, nothing
    is gathered; a hub's links meet one row of the label table, a skewed join that
    adaptive execution splits.
    """
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    open_links = materialise(ordered(links), "links")
    labels = open_links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not open_links.isEmpty():
        parents = _jump(open_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        labels = materialise(_relabelled(labels, "root", parents), "labels")
        open_links = materialise(ordered(_relabelled(_relabelled(open_links, "a", parents), "b", parents)), "links")
    return labels
