"""Undirected property graphs as two DataFrames, and keyed updates on them.

Edges are stored in both directions, without self-loops or repeats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triadic.scratch import Scratch


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each row (src, dst, ...) and the same with its ends exchanged."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return pairs.select(both.alias("e"), *rest).select("e.src", "e.dst", *rest)


def with_reverse(pairs: DataFrame) -> DataFrame:
    """As both_ways, of a stored table: it is read twice, so that a filter of one end, and a choice of columns, reach the reader."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    return pairs.select("src", "dst", *rest).union(pairs.select("dst", "src", *rest))


def symmetrize(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair (src, dst), without self-loops and repeats."""
    return both_ways(pairs.select("src", "dst").where("src <> dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, adj): sorted neighbours of each vertex."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("adj"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree)"""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@dataclass(frozen=True)
class Graph:
    """vertices (id, ...) and edges (src, dst, ...)."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame) -> Graph:
        """Vertices are the ids in edges, which must be symmetric."""
        return Graph(edges.select(F.col("src").alias("id")).distinct(), edges)

    @staticmethod
    def from_pairs(pairs: DataFrame) -> Graph:
        return Graph.from_edges(symmetrize(pairs))

    def undirected_count(self) -> int:
        return self.edges.count() // 2

    def map_vertices(self, **columns: Column) -> Graph:
        return replace(self, vertices=self.vertices.select("id", *(c.alias(n) for n, c in columns.items())))

    def map_edges(self, **columns: Column) -> Graph:
        return replace(self, edges=self.edges.select("src", "dst", *(c.alias(n) for n, c in columns.items())))

    def join_vertices(self, other: DataFrame, update: dict[str, Column]) -> Graph:
        """Updates vertex columns where ``other`` (one row an id) has the id; others keep their values.

        In ``update``, columns of other are named ``new_<column>``.
        """
        new = other.select("id", *(F.col(c).alias(f"new_{c}") for c in other.columns if c != "id"), F.lit(True).alias("_hit"))
        v = self.vertices.join(new, "id", "left")
        cols = [F.when(F.col("_hit"), update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in self.vertices.columns]
        return replace(self, vertices=v.select(*cols))

    def join_edges_on(self, end: str, attribute: DataFrame, column: str, name: str) -> Graph:
        """Adds an attribute (id, column) of the source ("src") or target ("dst") to each edge; null without one."""
        a = attribute.select(F.col("id").alias(end), F.col(column).alias(name))
        return replace(self, edges=self.edges.join(a, end, "left").select(*self.edges.columns, name))

    def join_edges(self, other: DataFrame, update: dict[str, Column]) -> Graph:
        """Updates edge columns by (src, dst), as join_vertices does for vertices."""
        new = other.select("src", "dst", *(F.col(c).alias(f"new_{c}") for c in other.columns if c not in ("src", "dst")), F.lit(True).alias("_hit"))
        e = self.edges.join(new, ["src", "dst"], "left")
        cols = [F.when(F.col("_hit"), update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in self.edges.columns]
        return replace(self, edges=e.select(*cols))

    def subgraph(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Vertices that pass, and edges that pass between those."""
        v = self.vertices if vertex is None else self.vertices.where(vertex)
        e = self.edges if edge is None else self.edges.where(edge)
        if vertex is not None:
            ids = v.select("id")
            for end in ("src", "dst"):
                e = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return Graph(v, e.select(*self.edges.columns))

    def triplets(self) -> DataFrame:
        """Edges with the columns of both ends, as src_<column> and dst_<column>."""
        out = self.edges
        for end in ("src", "dst"):
            out = out.join(self.vertices.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in self.vertices.columns if c != "id")), end)
        return out

    def union(self, other: Graph) -> Graph:
        return Graph(self.vertices.unionByName(other.vertices).dropDuplicates(["id"]), self.edges.unionByName(other.edges).dropDuplicates(["src", "dst"]))

    def pregel(self, message: Column, combine: Callable[[Column], Column], update: dict[str, Column], max_supersteps: int, send: Column | None = None) -> Graph:
        """Vertex-centric supersteps: along each edge a ``message`` from triplet columns, combined for each
        target, updates vertex columns (the combined message is ``message``; null: none came).

        Ends when no vertex changes or after ``max_supersteps``. Only the vertex
        table is rewritten in each round.
        """
        scratch = Scratch(self.vertices.sparkSession, "pregel")
        g = replace(self, vertices=scratch.table(self.vertices))
        for _ in range(max_supersteps):
            t = g.triplets() if send is None else g.triplets().where(send)
            inbox = t.select(F.col("dst").alias("id"), message.alias("m")).groupBy("id").agg(combine(F.col("m")).alias("message"))
            v = g.vertices.join(inbox, "id", "left")
            rows = {c: F.when(F.col("message").isNotNull(), update[c]).otherwise(F.col(c)) if c in update else F.col(c) for c in g.vertices.columns}
            changed = F.lit(False)
            for c in update:
                changed = changed | ~rows[c].eqNullSafe(F.col(c))
            new = scratch.table(v.select(*(c.alias(n) for n, c in rows.items()), changed.alias("_changed")))
            g = replace(g, vertices=new.drop("_changed"))
            if new.where("_changed").isEmpty():
                break
        return g
