"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is two rounds of "minimum per node, joined back to the edges": no neighbour list
is ever collected, so a hub of any degree is spread by the partial aggregate and the skew join.
Each round's edges are written to the shared folder; nothing but two numbers reaches the driver.
Rounds end when the edges are stars, which is counted, so that no round is run only to change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomark.llm.common import in_few, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a node of one edge down to one that has none to a lesser node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("is_top"), (F.col("u") < F.col("v")).cast("int").alias("upward"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("is_top"), F.lit(0).alias("upward")))
    nodes = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("is_top").alias("is_top"), F.max("upward").alias("upward"))
    return nodes.agg(F.count_if(F.expr("ups > 1 OR (ups > 0 AND is_top = 1) OR upward = 1"))).first()[0] == 0


def connected_components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """edges(u, v) of one comparable type -> (node, root): the least node reachable, for nodes with an edge.

    Self loops, repeated edges and nulls are allowed; rows with a null end are no edge. ``nodes``: how many there are at most, if
    that is known, so that few edges are not dealt to many tasks.
    """
    given = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct()
    now = stored(given if nodes is None else in_few(given, nodes), "cc-edges")
    while not _are_stars(now):
        now = stored(in_few(_small_star(_large_star(now)), now.count()), "cc-edges")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(tops)
