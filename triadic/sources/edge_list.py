"""Edge lists: text files with one pair of ids a line, and graphs derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triadic.operators.graph import Graph, both_ways, symmetrize
from triadic.scratch import Scratch

SCHEMA = "src long, dst long"


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Pairs (src, dst) as written: no header, no inference, malformed lines fail."""
    return spark.read.schema(SCHEMA).option("sep", sep).option("mode", "FAILFAST").csv(path)


def load_graph(spark: SparkSession, path: str, sep: str = " ") -> Graph:
    return Graph.from_edges(symmetrize(read_edge_list(spark, path, sep)))


def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts that share an order, of all orders.

    Only two columns are read; orders are small, so the self-join by order has
    no hot key. One shuffle by order serves repeats and both sides of the join.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    other = items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return items.join(other, "l_orderkey").where(F.col("l_partkey") < F.col("dst")).select(F.col("l_partkey").alias("src"), "dst").distinct()


def stored_pairs(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """copurchase_pairs as a table, sorted in each of its files, which hold whole values of src.

    Orders are a table of lists of parts first, made in slices. Pairs come from those
    without a shuffle, so only a slice of items or pairs is in shuffle files at once.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").where("l_orderkey is not null")
    parts = lambda e: e.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    orders = scratch.sliced(items, "l_orderkey", lambda e: parts(e).where("size(parts) > 1").select("parts"))
    scratch.release()
    n = orders.agg(F.sum(F.expr("size(parts) * (size(parts) - 1L) div 2"))).first()[0] or 0
    pairs = orders.select("parts", F.posexplode("parts").alias("i", "src")).select("src", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("dst"))
    out = scratch.sliced(pairs, "src", lambda e: e.repartition("src").distinct().sortWithinPartitions("src", "dst"), n)
    scratch.drop(orders)
    return out


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric edges of the co-purchase graph. Its pairs are distinct and ordered, so both directions of them are as well."""
    return both_ways(copurchase_pairs(spark, sf_dir))
