"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnwave.session import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (both long): every node of the edges with one node of its component, the same for all of it.

    In each round a node moves to its least neighbour (or stays, if it is less), and edges move with their
    ends; what becomes a loop or a repeat goes. Least is by id in even rounds, so that stars vanish at once, and by
    a hash that changes with the round in odd ones, so that chains in id order shrink by a constant factor
    too. Ends after as many rounds as it takes; each round stores its moves and its edges. Loops and nulls among the edges are ignored.
    """
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    left = stored(left.select(*pair).distinct(), "edges")
    labels = None
    turn = 0
    while not left.isEmpty():
        def rank(node, turn=turn):
            order = F.xxhash64(node, F.lit(turn)) if turn % 2 else F.lit(0).cast("long")
            return F.struct(order.alias("order"), F.col(node).alias("id"))

        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        nearest = ends.groupBy("u").agg(F.min(rank("v")).alias("v"))
        moves = stored(nearest.select("u", F.least("v", rank("u"))["id"].alias("to")), "moves")
        labels = moves.select(F.col("u").alias("node"), F.col("to").alias("root")) if labels is None else _follow(labels, moves)
        moved = left.join(moves.withColumnsRenamed({"u": "a", "to": "a2"}), "a").join(moves.withColumnsRenamed({"u": "b", "to": "b2"}), "b")
        left = stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "edges")
        turn += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _follow(labels: DataFrame, moves: DataFrame) -> DataFrame:
    moved = labels.join(moves, labels["root"] == moves["u"], "left")
    return moved.select("node", F.coalesce("to", "root").alias("root"))
