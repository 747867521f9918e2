"""Connected components by alternating star operations, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import HOT_ROWS, joined_by_hot_key, replaced_by, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, least: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """edges with least's columns by u, of whose column n no value exceeds rows."""
    if rows <= hot_rows:
        return edges.join(least.drop("n"), "u")
    return joined_by_hot_key(edges, written(least, "least"), "u", "n", hot_rows)


def _large_star(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Every neighbour above a node hangs on the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    up = _with_least(both.filter("v > u"), least, rows, hot_rows)
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """Every neighbour below a node, and the node itself, hang on its smallest neighbour. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    down = _with_least(edges, least, rows, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node of its part.

    Loops and repeated edges are ignored; no edges give an empty table. Each round is written to the shared
    folder, and the one before is deleted; rounds grow with the logarithm of the longest path. Nodes of more than
    hot_rows edges are joined by broadcast, so a hub isn't one task's. Raises if most_rounds don't suffice.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")
    state = _state(e)
    for _ in range(most_rounds if state[0] else 0):
        large = _large_star(e, state[0], hot_rows)
        if state[0] > hot_rows:
            large = written(large, "edges")
        e = replaced_by(e, written(_small_star(large, state[0], hot_rows), "edges"))
        before, state = state, _state(e)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
