"""Connected components of a link table by alternating large and small stars.

Every round is two grouped minima and two joins on node ids; only two numbers per round (count
and checksum of the links) reach the driver. Stars make the depth of the graph halve from round
to round, so that the number of rounds grows with its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import materialise


def _state(links: DataFrame) -> tuple:
    # a sum of decimals neither overflows nor depends on the order of rows
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Links (u, v), any direction: joins each node's larger neighbours to its least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Links (u, v) with u > v: joins each node and its smaller neighbours to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, stem: str = "stars") -> DataFrame:
    """(u, v), null-free, to (node, component): the least node that can be reached.

    Only nodes that have a link to another node appear. Repeated links and self-links are fine.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    links = links.where("u <> v").select(most.alias("u"), least.alias("v")).distinct()
    links = materialise(links, stem)
    state = _state(links)
    while state[0]:
        links = materialise(_small_star(_large_star(links)), stem)
        before, state = state, _state(links)
        if state == before:
            break
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
