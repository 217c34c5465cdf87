"""Absorbing batches of new edges without a full recount.

What a batch changes are the triangles with at least one new edge: they are
found from the new edges alone, and counts, supported neighbours and the pruned
graph grow by them. The merged graph is carried on, counts of all vertices are
kept, and the movement of a vertex sees all communities next to it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.functions.metric import clustering
from triadic.operators.communities import global_wcc
from triadic.operators.detect import assemble, detect_communities
from triadic.operators.graph import Graph, both_ways, symmetrize
from triadic.operators.prune import Pruned, prune
from triadic.operators.refine import rounds
from triadic.operators.seed import initial_partition
from triadic.operators.triangles import corner_counts, edge_support, triangles
from triadic.scratch import Scratch


def max_vertex(edges: DataFrame) -> int | None:
    return edges.agg(F.max("dst")).first()[0]


def split_point(largest: int, ratio: float = 0.8) -> int:
    """floor(largest x ratio) in 32-bit floats."""
    return int(np.floor(np.float64(np.float32(largest) * np.float32(ratio))))


def bulk_edges(edges: DataFrame, split: int) -> DataFrame:
    return edges.where((F.col("src") < split) & (F.col("dst") < split))


def stream_edges(edges: DataFrame, split: int) -> DataFrame:
    return edges.where((F.col("src") >= split) | (F.col("dst") >= split))


def batch_ranges(largest: int, split: int, n: int = 1) -> list[tuple[int, int]]:
    """[lo, hi) of each micro-batch; an edge belongs to the range of its larger end."""
    size = (largest - split) // n
    return [(split + k * size, largest + 1 if k == n - 1 else split + (k + 1) * size) for k in range(n)]


def batch_edges(stream: DataFrame, lo: int, hi: int) -> DataFrame:
    end = F.greatest("src", "dst")
    return stream.where((end >= lo) & (end < hi))


def batch_vertices(batch: DataFrame) -> DataFrame:
    return batch.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def border_vertices(vertices: DataFrame, batch: DataFrame) -> DataFrame:
    """Vertices that are there already and that the batch touches."""
    return batch_vertices(batch).join(vertices.select("id"), "id", "left_semi")


def new_vertices(vertices: DataFrame, batch: DataFrame) -> DataFrame:
    return batch_vertices(batch).join(vertices.select("id"), "id", "left_anti")


def delta_triangles(merged: DataFrame, fresh: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """(a, b, c) of the triangles of ``merged`` that hold an edge of ``fresh`` (both symmetric).

    All edges of such a triangle have an end that a new edge has as well, so where
    those ends are few only edges at them are searched.
    """
    scratch = Scratch(merged.sparkSession, "delta")
    ids = scratch.table(fresh.select(F.col("src").alias("id")).distinct())
    near = merged.where("src < dst").select("src", "dst")
    if ids.limit(most_broadcast + 1).count() <= most_broadcast:
        for end in ("src", "dst"):
            near = near.join(F.broadcast(ids.select(F.col("id").alias(end), F.lit(True).alias(f"at_{end}"))), end, "left")
        near = near.where("at_src or at_dst").select("src", "dst")
    marked = near.withColumn("fresh", F.lit(False)).unionByName(fresh.where("src < dst").select("src", "dst", F.lit(True).alias("fresh")))
    known = scratch.table(marked.groupBy("src", "dst").agg(F.max("fresh").alias("fresh")))
    scratch.release()
    return triangles(both_ways(known))


def delta_stats(delta: DataFrame, supported: DataFrame) -> DataFrame:
    """(id, dt, dvt): what vertices gain in triangles and in supported neighbours."""
    new_support = edge_support(delta).select("src", "dst").join(supported, ["src", "dst"], "left_anti")
    dvt = new_support.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("dvt"))
    return corner_counts(delta, "dt").join(dvt, "id", "left").select("id", "dt", F.coalesce("dvt", F.lit(0)).cast("long").alias("dvt"))


def updated_vertices(vertices: DataFrame, batch: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, t, vt, cc, cid) of old and new vertices; those whose counts change, and new ones, are labelled by themselves."""
    ids = vertices.select("id").unionByName(batch_vertices(batch)).distinct()
    v = ids.join(vertices.select("id", "t", "vt", "cid"), "id", "left").join(stats, "id", "left")
    t, vt = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) for a, b in (("t", "dt"), ("vt", "dvt")))
    v = v.select("id", t.alias("t"), vt.alias("vt"), F.when(F.col("dt").isNull(), F.coalesce("cid", "id")).otherwise(F.col("id")).alias("cid"))
    return v.select("id", "t", "vt", clustering(F.col("t"), F.col("vt")).alias("cc"), "cid")


@dataclass
class State:
    """What is carried from batch to batch: vertices (id, t, vt, cc, cid), symmetric edges, supported edges and triangles.

    metrics: what the last step counted, its omega and WCC, and its seconds.
    """

    vertices: DataFrame
    edges: DataFrame
    supported: DataFrame
    triangles: DataFrame
    metrics: dict = field(default_factory=dict)


def bootstrap(edges: DataFrame, max_retries: int = 5) -> State:
    d = detect_communities(edges, max_retries)
    scratch = Scratch(edges.sparkSession, "bootstrap")
    return State(scratch.table(d.vertices), d.edges, d.pruned.edges, d.pruned.triangles, d.metrics)


def counted(edges: DataFrame) -> State:
    """A state with the counts of a bootstrap, each vertex a community of its own.

    Absorbing a batch seeds the merged graph anew, so labels before it don't
    matter to what comes after (see absorb).
    """
    scratch = Scratch(edges.sparkSession, "counted")
    edges = scratch.table(edges.select("src", "dst"))
    p = prune(edges, scratch)
    return State(scratch.table(assemble(edges, p, p.vertices.select("id", F.col("id").alias("cid")))), edges, p.edges, p.triangles)


def absorb(state: State, batch: DataFrame, n_rounds: int = 5) -> State:
    """The state with the batch's edges; a batch that is absorbed again changes no edge or count.

    Triangles, counts and the pruned graph grow by what the batch adds. The seed
    is that of the merged graph and refinement runs ``n_rounds`` rounds without a
    test of WCC, as the semantics ask, so labels cost what those rounds cost on
    the whole graph.
    """
    scratch, began = Scratch(state.edges.sparkSession, "absorb"), time.time()
    touched = scratch.table(batch_vertices(batch))
    fresh = scratch.table(symmetrize(batch.select("src", "dst")).join(state.edges, ["src", "dst"], "left_anti"))
    merged = scratch.table(Graph.from_edges(state.edges.unionByName(fresh)).edges)
    delta = scratch.table(delta_triangles(merged, fresh))
    stats = delta_stats(delta, state.supported)
    vertices = scratch.table(updated_vertices(state.vertices, batch, stats))
    supported = scratch.table(state.supported.unionByName(edge_support(delta).select("src", "dst")).distinct())
    tri = scratch.table(state.triangles.unionByName(delta))
    p = Pruned(vertices.where("t > 0").select("id", "t", "vt", "cc"), supported, tri, vertices.count())
    counted_at = time.time()
    seed = scratch.table(initial_partition(p, scratch))
    seeded = time.time()
    labels = rounds(p, seed.select("id", "cid"), scratch, n_rounds)
    out = scratch.table(assemble(merged, p, labels))
    refined = time.time()
    old = touched.join(state.vertices.select("id"), "id", "left_semi").count()
    metrics = {
        "vertices": p.vertex_count, "new_edges": fresh.count() // 2, "border_vertices": old, "new_vertices": touched.count() - old, "new_triangles": delta.count(),
        "omega": p.omega, "wcc": global_wcc(p, labels), "seconds": {"merge": counted_at - began, "seed": seeded - counted_at, "rounds": refined - seeded},
    }
    scratch.retain(out, merged, supported, tri)
    return State(out, merged, supported, tri, metrics)


def replay(edges: DataFrame, ratio: float = 0.8, batches: int = 1, n_rounds: int = 5) -> State:
    """Splits edges by vertex id into a bulk and a stream of micro-batches, and runs through them.

    The bulk is counted, not refined: only the labels after the last batch are returned, and they don't depend on it.
    """
    largest = max_vertex(edges)
    if largest is None:
        return bootstrap(edges)
    split = split_point(largest, ratio)
    state, stream = counted(bulk_edges(edges, split)), stream_edges(edges, split)
    for lo, hi in batch_ranges(largest, split, batches):
        state = absorb(state, batch_edges(stream, lo, hi), n_rounds)
    return state
