"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``u`` to its smaller end ``v``; loops go."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return spread_join(both.where("v > u"), smallest, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = spread_join(edges, smallest, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(smallest.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node is the larger end of two edges, or the larger end of one and the smaller of another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(2).alias("n")), F.struct(F.col("v").alias("node"), F.lit(1).alias("n")))).alias("e"))
    uses = ends.select("e.*").groupBy("node").agg(F.max("n").alias("most"), F.count("*").alias("times"))
    return uses.where("most = 2 and times > 1").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node that isn't its component's smallest, from a table of edges ``u, v``.

    Each round is a fixed number of joins on a node, with the edges of one node dealt out, cut to the shared folder; the number of rounds grows with the
    logarithm of the components' sizes. Loops, repeated and reversed edges count once, edges with a null end not at
    all; no edges give no rows.
    """
    edges = cut(_directed(edges))
    while not _are_stars(edges):
        edges = cut(_directed(_small_star(_directed(_large_star(edges)))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
