"""Connected components by contraction: no group is gathered, the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settled, written

MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long): component is the smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are followed once more, and the graph is contracted
    along them; a round leaves at most half of the nodes of each part. Null ends are ignored; loops and repeated edges
    change nothing; without edges there are no rows."""
    return settled(lambda: _contracted(edges), "components")


def _contracted(edges: DataFrame) -> DataFrame:
    left = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "pointers")
        next_ = point.select(F.col("node").alias("to"), F.col("to").alias("on"))
        jump = written(point.join(next_, "to").select("node", F.col("on").alias("to")), "pointers")
        if labels is None:
            labels = jump.select("node", F.col("to").alias("component"))
        else:
            moved = jump.select(F.col("node").alias("component"), "to")
            labels = written(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        a, b = (jump.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        left = written(left.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components didn't settle")
    return labels if labels is not None else edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("component")).limit(0)
