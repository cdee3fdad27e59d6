"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables


def _edges(df: DataFrame) -> DataFrame:
    return df.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node that it sees."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _edges(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _edges(hooked.union(least.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, tables: Tables, name: str = "stars") -> DataFrame:
    """(node, component) for every node with an edge to another one.

    ``edges`` has two bigint columns, u and v; nulls, loops and repeated edges
    don't matter. The component is the least node that can be reached. Only sums
    over the edges reach the driver. Each round of both steps is written to the
    shared folder, and the rounds end when the edges are stars that no longer
    change, after O(log^2 n) rounds.
    """
    now = tables.write(_edges(edges), f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        then = tables.write(_small_star(_large_star(now)), f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}")
        was, state, now = state, _state(then), then
        if was == state:
            break
    roots = now.groupBy("v").agg(F.count("*")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
