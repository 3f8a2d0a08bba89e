"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import materialize

#: Times that pointers are shortened in a round.
JUMPS = 2


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; a component is named by its smallest node.

    In each round every node points at its smallest neighbour, if that is
    smaller, pointers are shortened, and the links are drawn between what the
    nodes point at; links inside one node vanish. So the graph shrinks fast, and
    only nodes still linked are handled again. Minima combine before the shuffle:
    a node with very many links costs a row per task. Every round is written to
    the shared folder; nothing but "are links left" reaches the driver.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("next"))
    both = materialize(pairs.unionByName(pairs.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct(), "edges")
    labels = materialize(both.select("node").distinct().withColumn("component", F.col("node")), "labels")
    edges = both.where("node <> next")
    while not edges.isEmpty():
        parents = materialize(edges.groupBy("node").agg(F.least(F.first("node"), F.min("next")).alias("parent")), "parents")
        for _ in range(JUMPS):
            above = parents.select(F.col("node").alias("_above"), F.col("parent").alias("_top"))
            parents = materialize(
                parents.join(above, F.col("parent") == F.col("_above"), "left")
                .select("node", F.coalesce("_top", "parent").alias("parent")), "parents",
            )
        to = parents.select(F.col("node").alias("component"), "parent")
        labels = materialize(
            labels.join(to, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels"
        )
        other = parents.select(F.col("node").alias("next"), F.col("parent").alias("next_parent"))
        edges = materialize(
            edges.join(parents, "node").join(other, "next").where("parent <> next_parent")
            .select(F.col("parent").alias("node"), F.col("next_parent").alias("next")).distinct(), "edges",
        )
    return labels
