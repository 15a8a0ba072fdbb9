"""Connected components of a link table, as joins and aggregates that keep no component in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (x, y): nodes have one root if and only if links join them.

    Each round every node points to the smallest of itself and its neighbours, and the links are redrawn between the
    nodes pointed to, until none is left.  A hub costs one aggregated row a task.  Null ends and loops give no link.
    """
    tables = Scratch(links.sparkSession)
    links = links.select("x", "y").where("x <> y")
    edges = tables.write(links.union(links.select("y", "x")).distinct(), "edges")
    nodes = None
    while not edges.isEmpty():
        to = tables.write(edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "pointers")
        ends = to.select(F.col("x").alias("y"), F.col("to").alias("to_y"))
        drawn = edges.join(to, "x").join(ends, "y").where("to <> to_y").select(F.col("to").alias("x"), F.col("to_y").alias("y"))
        hop = to.select(F.col("x").alias("root"), F.col("to"))
        moved = to.withColumnsRenamed({"x": "node", "to": "root"}) if nodes is None else nodes.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        moved, left = tables.write(moved, "roots"), tables.write(drawn.distinct(), "edges")
        tables.drop(nodes, to, edges)
        nodes, edges = moved, left
    return links.select(F.col("x").alias("node"), F.col("x").alias("root")).limit(0) if nodes is None else nodes
