"""Connected components of a graph given as edge rows, by repeated hooking and contraction.

Each round hooks every node to its least neighbour, shortens the chains by pointer jumping, and
contracts the edges to the new labels; a round at least halves the number of components that still
have edges, so their number grows with the logarithm of the nodes. Each round's labels are written
to the shared folder, so a lost executor repeats one round. A hub with very many edges is split by
the joins' skew handling; its edges are pre-aggregated to a minimum. Nothing is collected but one
yes or no a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component: the least node reachable.

    Repeated edges, edges in both directions and loops are fine; rows with a null end are ignored.
    No edges: an empty table."""
    todo = materialize_table(edges.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = todo.select(F.col("a").alias("node")).union(todo.select("b")).distinct().withColumn("component", F.col("node"))
    todo = todo.where("a < b")
    while not todo.isEmpty():
        hook = todo.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y"))  # a < b: strictly downwards, so no cycles
        for _ in range(2):
            hook = hook.join(hook.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left") \
                .select("x", F.coalesce("z", "y").alias("y"))
        hook = materialize_table(hook, "hook")
        labels = materialize_table(
            labels.join(hook, labels["component"] == hook["x"], "left")
            .select("node", F.coalesce("y", "component").alias("component")), "labels")
        a, b = hook.select(F.col("x").alias("a"), F.col("y").alias("ra")), hook.select(F.col("x").alias("b"), F.col("y").alias("rb"))
        todo = todo.join(a, "a", "left").join(b, "b", "left") \
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        todo = materialize_table(
            todo.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
