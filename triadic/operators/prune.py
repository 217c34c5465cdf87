"""Pruning: only vertices and edges that close a triangle stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.functions.metric import clustering
from triadic.operators.graph import with_reverse
from triadic.operators.triangles import edge_support, supports, triangles
from triadic.scratch import Scratch


@dataclass
class Pruned:
    """vertices (id, t, vt, cc), edges (src, dst) and, unless they were not asked for, triangles (a, b, c) of the pruned graph; vertex_count is that of the whole graph."""

    vertices: DataFrame
    edges: DataFrame
    triangles: DataFrame | None
    vertex_count: int
    _omega: float | None = None

    @property
    def omega(self) -> float:
        """Sum of the clustering coefficients by the number of vertices of the whole graph (0 without vertices)."""
        if self._omega is None:
            total = self.vertices.agg(F.sum(F.round("cc", 12).cast("decimal(38,12)")).cast("double")).first()[0] or 0.0
            self._omega = total / self.vertex_count if self.vertex_count else 0.0
        return self._omega


def pruned_vertices(support: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, t, vt, cc): t triangles, vt supported neighbours. support: symmetric (src, dst, support); a triangle counts at two edges of each corner."""
    ends = support.select(F.col("src").alias("id"), "support")
    v = scratch.sliced(ends, "id", lambda e: e.groupBy("id").agg(F.expr("sum(support) div 2").alias("t"), F.count(F.lit(1)).alias("vt")))
    scratch.release()
    return v.select("id", "t", "vt", clustering(F.col("t"), F.col("vt")).alias("cc"))


def prune(edges: DataFrame, scratch: Scratch, keep_triangles: bool = True, spent: bool = False) -> Pruned:
    """edges: symmetric and stored, any graph. An edge of a triangle has ends with t > 0, so the supports say all.

    Without keep_triangles they are no table, and the result has none; and with spent
    other tables of scratch go early, edges too.
    """
    if keep_triangles:
        tri, n = triangles(edges, scratch), edges.select("src").distinct().count()
        support = edge_support(tri, scratch)
    else:
        tri = None
        pairs, n = supports(edges, scratch, spent)
        support = with_reverse(pairs.where("support > 0"))
    scratch.release()
    return Pruned(pruned_vertices(support, scratch), support.select("src", "dst"), tri, n)
