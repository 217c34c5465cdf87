"""Statistics of a partition: labels (id, cid) of the pruned graph's vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.functions.metric import density, vertex_wcc
from triadic.operators.prune import Pruned
from triadic.operators.graph import with_reverse
from triadic.operators.triangles import corner_counts, triangles
from triadic.scratch import Scratch, broadcast_if_small


def community_sizes(labels: DataFrame) -> DataFrame:
    """(cid, r)"""
    return labels.groupBy("cid").agg(F.count(F.lit(1)).alias("r"))


def community_degrees(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, cid, din): edges from each vertex into each community next to it."""
    e = edges.join(broadcast_if_small(labels.select(F.col("id").alias("dst"), "cid")), "dst").select("src", "cid").repartition("src")
    return e.groupBy(F.col("src").alias("id"), "cid").agg(F.count(F.lit(1)).alias("din"))


def own_degrees(deg: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, own, d_own, d_all): edges of each vertex into its own community, and all."""
    d = deg.join(labels.select("id", F.col("cid").alias("own")), "id")
    return d.groupBy("id", "own").agg(F.sum(F.when(F.col("cid") == F.col("own"), F.col("din")).otherwise(0)).alias("d_own"), F.sum("din").alias("d_all"))


def own_counts(p: Pruned, labels: DataFrame) -> DataFrame:
    """own_degrees of the pruned graph, from the edges inside communities alone, which are few; vt is the number of all."""
    inner = inner_edges(p.edges, labels).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    v = p.vertices.select("id", F.col("vt").alias("d_all")).join(labels.select("id", F.col("cid").alias("own")), "id").join(inner, "id", "left")
    return v.select("id", "own", F.coalesce("d", F.lit(0)).cast("long").alias("d_own"), "d_all")


def community_edges(own: DataFrame) -> DataFrame:
    """(cid, a, b): edges inside a community, and between it and others, each undirected edge once."""
    return own.groupBy(F.col("own").alias("cid")).agg(F.expr("sum(d_own) div 2").alias("a"), F.sum(F.col("d_all") - F.col("d_own")).alias("b"))


def community_stats(labels: DataFrame, own: DataFrame) -> DataFrame:
    """(cid, r, a, b, d)"""
    s = community_sizes(labels).join(community_edges(own), "cid", "left").select("cid", "r", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in "ab"))
    return s.withColumn("d", density(F.col("r"), F.col("a")))


def community_neighbors(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, neighbors): sorted neighbours in the same community; empty without any."""
    n = inner_edges(edges, labels).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("n"))
    return labels.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.array().cast("array<long>")).alias("neighbors"))


def inner_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends share a community, of symmetric and stored edges; a table, of each edge once, made in slices."""
    near = broadcast_if_small(labels.select("id", "cid"))
    of = lambda end: near.select(F.col("id").alias(end), F.col("cid").alias(f"c_{end}"))
    scratch = Scratch(edges.sparkSession, "inner")
    inner = scratch.sliced(edges.where("src < dst"), "src", lambda e: e.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
    return with_reverse(inner)


def community_triangles(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, tc): triangles of a vertex whose corners share its community, for vertices with any.

    They are the triangles of the edges inside communities, which are few beside
    all triangles, so the table of those is not shuffled.
    """
    return corner_counts(triangles(inner_edges(edges, labels)), "tc")


def vertex_scores(p: Pruned, labels: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(id, cid, wcc) for each vertex of the pruned graph."""
    own = own_counts(p, labels) if own is None else own
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    v = p.vertices.join(labels.select("id", "cid"), "id").join(own.select("id", "d_own"), "id", "left").join(community_triangles(p.edges, labels), "id", "left").join(community_sizes(labels), "cid")
    return v.select("id", "cid", vertex_wcc(F.col("t"), F.col("vt"), zero("tc"), zero("d_own"), F.col("r")).alias("wcc"))


def global_wcc_sum(scores: DataFrame):
    """Sum of wcc, rounded to 12 places first so that the order of addition can't show."""
    return scores.agg(F.sum(F.round("wcc", 12).cast("decimal(38,12)")).cast("double").alias("s"))


def global_wcc(p: Pruned, labels: DataFrame, own: DataFrame | None = None) -> float:
    return (global_wcc_sum(vertex_scores(p, labels, own)).first()[0] or 0.0) / p.vertex_count if p.vertex_count else 0.0
