"""Connected components of a graph of any size, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.workspace import keep

MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b): the smallest node that
    it reaches. Nodes without a link are not in the result.

    Every node points to the smallest node around it; following the pointers, twice as
    far each time, leads to the roots of a forest; links are moved to the roots, and
    those inside one tree go. That is repeated with what is left until no link is.
    A step is a grouping or a join by node, written to the shared folder.
    """
    edges = keep(_between(links.select("a", "b")), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = keep(nodes.withColumn("component", F.col("node")), "labels")
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            return labels
        roots = _roots(edges)
        labels = keep(_moved(labels, roots, "component"), "labels")
        edges = keep(_between(_moved(_moved(edges, roots, "a"), roots, "b")), "links")
    raise RuntimeError("components did not settle")


def _between(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _moved(table: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root, where it has one."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return table.join(named, column, "left").withColumn(column, F.coalesce("_root", column)).select(table.columns)


def _roots(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that is not a root itself."""
    both = edges.union(edges.select("b", "a"))
    pointers = keep(both.groupBy("a").agg(F.min("b").alias("root")).where("root < a").withColumnRenamed("a", "node"), "pointers")
    for _ in range(MOST_ROUNDS):
        following = keep(_moved(pointers, pointers, "root"), "pointers")
        changed = not following.join(pointers, ["node", "root"], "left_anti").isEmpty()
        pointers = following
        if not changed:
            return pointers
    raise RuntimeError("pointers did not settle")
