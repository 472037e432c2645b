"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forumlens.sources.snapshots import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``, numbers): equal labels mean one component.

    Each round lets every node point to its least neighbour, follows the pointers two steps, and contracts the
    graph to what they point to; a round at least halves the nodes that still have edges. Rounds are written
    tables, so a lost executor costs a task, and the only minimum over a node's edges is combined inside the
    tasks, so a node may have any number of them. NULL ends and loops are no edges; no edges give no rows.
    """
    edges = materialize(_ordered(edges))
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        up = up.withColumnRenamed("a", "node")
        pointers = materialize(_follow(_follow(up, up), up))
        edges = materialize(_ordered(_renamed(_renamed(edges, "a", pointers), "b", pointers)))
        labels = pointers.withColumnRenamed("up", "label") if labels is None else _relabelled(labels, pointers)
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _ordered(edges: DataFrame) -> DataFrame:
    kept = edges.where(F.col("a") != F.col("b"))
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(pointers: DataFrame, up: DataFrame) -> DataFrame:
    further = up.select(F.col("node").alias("middle"), F.col("up").alias("further"))
    joined = pointers.join(further, pointers["up"] == further["middle"])
    return joined.select("node", F.col("further").alias("up"))


def _renamed(edges: DataFrame, end: str, pointers: DataFrame) -> DataFrame:
    """Edges whose end is replaced by what it points to."""
    joined = edges.join(pointers, edges[end] == pointers["node"])
    other = "b" if end == "a" else "a"
    return joined.select(F.col("up").alias(end), other)


def _relabelled(labels: DataFrame, pointers: DataFrame) -> DataFrame:
    moved = pointers.select(F.col("node").alias("old"), "up")
    joined = labels.join(moved, labels["label"] == moved["old"], "left")
    return joined.select("node", F.coalesce("up", "label").alias("label"))
