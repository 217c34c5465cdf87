"""CSV outputs: comma between fields, a line a row, overwriting what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from triadic.operators.communities import community_degrees, community_stats, own_degrees
from triadic.operators.detect import Detection
from triadic.operators.graph import degrees
from triadic.operators.incremental import State
from triadic.operators.triangles import corner_counts


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ",").csv(path)


def write_detection(d: Detection, path: str) -> dict[str, str]:
    """All outputs of a detection below ``path``; returns where each went."""
    seed = d.seed.select("id", "cid")
    counts = degrees(d.edges).join(corner_counts(d.pruned.triangles), "id", "left").fillna(0, ["t"]).select("id", "t", "degree")
    own = own_degrees(community_degrees(d.pruned.edges, seed), seed)
    tables = {
        "pruned_edges": d.pruned.edges.select("src", "dst"),
        "pruned_vertices": d.pruned.vertices.selectExpr("id", "id as cid"),
        "triangle_counts": counts,
        "initial_partition": seed,
        "initial_community_stats": community_stats(seed, own).select("cid", "r", "a", "b"),
        "final_partition": d.labels.select("id", "cid"),
    }
    for name, t in tables.items():
        write_csv(t, f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


def write_state(state: State, path: str) -> str:
    """The partition (id, cid) after the last batch, of all vertices."""
    write_csv(state.vertices.select("id", "cid"), f"{path}/incremental_partition")
    return f"{path}/incremental_partition"
