"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a link: component is the smallest node that links reach.

    Every round points a node's larger neighbours at the smallest one, then its
    smaller neighbours, until all links are stars; the number of rounds is
    logarithmic in the longest path. Only aggregates and equi-joins by node are
    used, each on stored tables, so a node with very many links is split by
    adaptive joins, and nothing is gathered in one task or on the driver. Links
    with a null end or from a node to itself say nothing. No links: no rows.
    No table has more rows than there are links to begin with, but for the least
    neighbours, of which there are at most twice as many: few links make few files.
    """
    e = scratch.table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n = e.count()
    while True:
        one = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if one and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows=2 * n)
        large = scratch.table(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows=n)
        scratch.drop(e, least)
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), rows=n)
        e2 = scratch.table(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), rows=n)
        scratch.drop(large, low)
        e = e2
