"""Connected components by alternating large-star and small-star steps.

Every step is a combinable ``min`` per node and an equi-join on the node and a
salt of its neighbour, so a hub is pre-aggregated before the shuffle and its
edges are joined in ``SALTS`` tasks. A node is listed once for each salt that
its neighbours have, so no side grows by this.
Nothing but a count and a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


#: Tasks that share a hub's edges.
SALTS = 64


def _least(edges: DataFrame) -> DataFrame:
    """``u, salt, m``: the smallest of a node and its neighbours, for every salt they have."""
    salted = edges.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts"))
    return salted.select("u", F.explode("salts").alias("salt"), F.least("u", "m").alias("m"))


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs to ``(node, component)``, the component being its smallest node.

    Self-loops, repeated and reversed pairs and nulls are allowed; a node seen
    only in a self-loop is not returned. An empty input gives an empty result.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = _salted(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").join(_least(both), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _salted(large)
        small = large.join(_least(large), ["u", "salt"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, "edges")
        now = _mark(after)
        dropped(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
