"""Connected components by alternating large-star and small-star steps.

Cases: repeated edges count once, an edge from a node to itself makes no component, no edges give no rows. Ties cannot
arise, as nodes are told apart by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curdline.sources.tables import materialized


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.selectExpr("b", "a"))


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the least one around: the greater ones of each node, or the lesser ones and itself."""
    near = edges if small else _both_ways(edges)  # a small step sees each node's lesser neighbours only (a > b)
    # written first, so that the join does not share the aggregate's shuffle and Spark can split a hot node
    least = materialized(near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    hung = near.join(least, "a")
    moved = hung.selectExpr("b AS a", "least AS b") if small else hung.filter("b > a").selectExpr("b AS a", "least AS b")
    if small:
        moved = moved.union(least.selectExpr("a", "least AS b"))
    return moved.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the least node of the component.

    Each step is written to the shared folder. The steps end when both leave the edges as they are; their number
    grows with the logarithm of the number of nodes. Null ends are left out.
    """
    now = materialized(
        edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges"
    )
    mark = _fingerprint(now)
    while True:
        now = materialized(_starred(_starred(now, small=False), small=True), "stars")
        last, mark = mark, _fingerprint(now)
        if mark == last:
            return now.selectExpr("a AS node", "b AS root").union(now.selectExpr("b", "b").distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
