"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a map-side-combined minimum and an equi-join of two written tables, so that a node
with very many neighbours is a skewed join partition, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quirefold.llm.scratch import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no node has edges both ways: then the components are read off."""
    ends = edges.selectExpr("a as node", "1 as down", "0 as up").unionByName(edges.selectExpr("b as node", "0 as down", "1 as up"))
    tangled = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1")
    return tangled.isEmpty()


def _minimum(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    return scratch.save(edges.groupBy("a").agg(F.min("b").alias("m")), name)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` undirected -> ``(node, component)``: the smallest node reachable, for every node of an edge.

    Null ends and loops are ignored; an empty table gives an empty result. Raises if the stars have
    not settled after ``rounds`` rounds (the number needed grows with the logarithm of the diameter).
    """
    edges = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    current = scratch.save(edges, f"{name}-0")
    if current.isEmpty():
        return current.selectExpr("a as node", "b as component")
    for k in range(1, rounds + 1):
        both = current.unionByName(current.selectExpr("b as a", "a as b"))
        low = _minimum(scratch, both, f"{name}-{k}-large")
        large = (
            both.join(low.hint("merge"), "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        )
        large = scratch.save(large, f"{name}-{k}-stars")
        low2 = _minimum(scratch, large, f"{name}-{k}-small")
        small = (
            large.join(low2.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low2.selectExpr("a", "m as b")).distinct()
        )
        old, current = k - 1, scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large", f"{name}-{k}-stars", f"{name}-{k}-small", f"{name}-{old}")
        if _are_stars(current):
            stars = current.selectExpr("a as node", "b as component")
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"components have not settled after {rounds} rounds")
