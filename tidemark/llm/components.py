"""Connected components of an edge table, as Spark jobs over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones,
    are hung on the smallest node that it sees. Both keep components whole, and shrink every tree to a
    star in about the logarithm of its size. An edge moves at most once a step, and minima are taken
    before the shuffle, so a node with many edges is no burden beyond its edges' number.
    """
    current = scratch.write(_tidy(edges), f"{name}-0")
    step = 0
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        low = scratch.write(low, f"{name}-low")  # apart from the edges' shuffle, so that Spark may split a node of many edges
        large = both.where("b > a").join(low, "a").select(F.col("b"), F.col("low").alias("a"))
        current = scratch.write(_tidy(large), f"{name}-{step + 1}")
        # now every edge points from a larger node b to a smaller one a
        low = current.groupBy("b").agg(F.min("a").alias("low"))
        small = current.join(low, "b").select(F.col("a").alias("b"), F.col("low").alias("a"))
        hung = low.select("b", F.col("low").alias("a"))
        nxt = scratch.write(_tidy(small.unionByName(hung)), f"{name}-{step + 2}")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(*(f"{name}-{k}" for k in (step, step + 1)))
        current, step = nxt, step + 2
        if tuple(seen) == before:
            break
        before = tuple(seen)
    stars = current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    found = scratch.write(stars.unionByName(roots), f"{name}-stars")
    scratch.drop(f"{name}-{step}", f"{name}-low")
    return found


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node b to its smaller a; loops go."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
