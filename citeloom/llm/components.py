"""Connected components of a link table by alternating stars, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long), any order, repeats allowed -> (node, component), for linked nodes only.

    component is the smallest node that can be reached. Each round sends every node's larger
    neighbours, then its smaller ones, to the least neighbour; paths halve, so rounds grow with the
    logarithm of the longest path. Minima are pre-aggregated before they shuffle, neighbours are never
    gathered into a row, and each round is written to the shared folder.
    """
    edges = keep(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    state = _fingerprint(edges)
    while state[0]:
        edges = keep(_small_star(_large_star(edges)), "links")
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    found = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return found.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
    return row[0], row[1]


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("m").alias("u"), "v")
    own = least.select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()
