"""Community detection from edges to labels."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.operators.communities import community_stats, own_counts
from triadic.operators.prune import Pruned, prune
from triadic.operators.refine import refine
from triadic.operators.seed import initial_partition
from triadic.scratch import Scratch


@dataclass
class Detection:
    vertices: DataFrame  # id, t, vt, cc, cid of all vertices; those pruned are alone, with zeros
    edges: DataFrame
    pruned: Pruned
    seed: DataFrame
    labels: DataFrame  # id, cid of the pruned graph
    metrics: dict = field(default_factory=dict)

    def stats(self) -> DataFrame:
        return community_stats(self.labels, own_counts(self.pruned, self.labels))


def assemble(edges: DataFrame, p: Pruned, labels: DataFrame) -> DataFrame:
    """Labels and counts for every vertex; a vertex that was pruned is a community of its own."""
    v = edges.select(F.col("src").alias("id")).distinct().join(p.vertices, "id", "left").join(labels.select("id", "cid"), "id", "left")
    return v.select("id", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("vt", F.lit(0)).alias("vt"), F.coalesce("cc", F.lit(0.0)).alias("cc"), F.coalesce("cid", "id").alias("cid"))


def detect_communities(edges: DataFrame, max_retries: int = 5, max_supersteps: int = 50) -> Detection:
    """edges: symmetric (src, dst); see graph.symmetrize. An empty graph gives empty tables."""
    scratch, began = Scratch(edges.sparkSession, "detect"), time.time()
    edges = scratch.table(edges.select("src", "dst"))
    p = prune(edges, scratch)
    seed = scratch.table(initial_partition(p, scratch, max_supersteps))
    seeded = time.time()
    r = refine(p, seed.select("id", "cid"), scratch, max_retries)
    seconds = {"seed": seeded - began, "rounds": r.seconds, "total": time.time() - began}
    metrics = {"vertices": p.vertex_count, "omega": p.omega, "wcc_history": r.history, "rounds_accepted": r.accepted, "seconds": seconds}
    scratch.retain(edges, p.vertices, p.edges, p.triangles, seed, r.labels)
    return Detection(assemble(edges, p, r.labels), edges, p, seed, r.labels, metrics)
