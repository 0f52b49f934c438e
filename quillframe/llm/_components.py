"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is a node of it, the same for all its nodes.

    In each round every node moves to its smallest neighbour, or stays if it is
    smaller itself, and edges follow. Rounds grow with the logarithm of the
    longest path for all but contrived graphs; each leaves a smaller graph. Repeated
    edges and loops are allowed; edges with a null end join nothing to nothing and give no row. Ties
    cannot occur, since nodes differ. A node with very many edges is a minimum, combined before the shuffle, and a
    side that the join with its one new name may split. Without edges there are no rows.
    """
    edges = edges.filter("a is not null and b is not null")
    labels, given = None, edges
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
        else:  # a join a round, evaluated by the caller; the moves stay until then
            step = moves.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        left, right = moves.toDF("a", "x"), moves.toDF("b", "y")
        before, edges = edges, edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = materialize(edges, "edges")
        if before is not given:
            release(before)
        if edges.isEmpty():
            release(edges)
            return labels
