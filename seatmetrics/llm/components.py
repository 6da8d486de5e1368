"""Connected components by alternating large-star and small-star, every step a job over edges in files.

Least neighbours come from a pre-aggregated group-by and are read back from files, so that the join which hands
them to the edges can be split where one node has a large share of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatmetrics.llm.shared import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on ``edges`` (u, v) with u > v; large-star hands u's least neighbour to the larger ones, small-star to the smaller ones and u."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    least = settle(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m")), "least")
    if large:
        moved = around.join(least, around["u"] == least["at"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        joined = around.join(least, around["u"] == least["at"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = joined.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    return settle(moved.where("u <> v").distinct(), "star")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long ids in either order, repeats allowed).

    ``component`` is the smallest id that can be reached. Null ends and loops are no edges; no edges, no rows.
    """
    proper = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = settle(proper.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        following = _star(_star(now, True), False)
        reached = _mark(following)
        if reached == mark:
            break
        now, mark = following, reached
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return settle(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
