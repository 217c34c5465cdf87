"""Queries over the co-purchase graph of all orders, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triadic.functions.metric import with_vertex, without_vertex
from triadic.operators import communities as C
from triadic.operators import graph as G
from triadic.operators import incremental as I
from triadic.operators import refine as R
from triadic.operators import triangles as T
from triadic.operators.detect import detect_communities
from triadic.operators.prune import Pruned, prune
from triadic.operators.seed import initial_partition
from triadic.scratch import Scratch, broadcast_if_small
from triadic.sources.edge_list import copurchase, copurchase_pairs, load_graph, stored_pairs
from triadic.sources.sinks import write_detection, write_state

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__.removesuffix("_labels")] = f
    return f


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, "query")
    pairs = stored_pairs(spark, sf_dir, scratch)
    scratch.release()
    return G.with_reverse(pairs), scratch


def _pruned(spark: SparkSession, sf_dir: str) -> tuple[Pruned, Scratch]:
    """Of the graph, only what is pruned; the whole graph is dropped, and no triangle stored."""
    edges, scratch = _edges(spark, sf_dir)
    p = prune(edges, scratch, keep_triangles=False, spent=True)
    scratch.retain(p.vertices, p.edges)
    return p, scratch


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[Pruned, DataFrame, Scratch]:
    p, scratch = _pruned(spark, sf_dir)
    seed = scratch.table(initial_partition(p, scratch))
    scratch.retain(p.vertices, p.edges, seed)
    scratch.release()
    return p, seed, scratch


def _state(spark: SparkSession, sf_dir: str):
    p, seed, scratch = _seeded(spark, sf_dir)
    labels = seed.select("id", "cid")
    own = R.stored_own(p, labels, scratch)
    return p, labels, own, scratch.table(C.community_stats(labels, own)), scratch


def _degrees(p: Pruned, labels: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.sliced(p.edges, "src", lambda e: C.community_degrees(e, labels))


def _batch(spark: SparkSession, sf_dir: str):
    edges, scratch = _edges(spark, sf_dir)
    largest = I.max_vertex(edges)
    split = I.split_point(largest)
    return edges, I.bulk_edges(edges, split), I.stream_edges(edges, split), largest, split, scratch


def r6(c: str):
    return F.round(c, 6).alias(c)


@query
def edges_symmetrized(spark, sf_dir):
    return copurchase(spark, sf_dir)


@query
def adjacency_list(spark, sf_dir):
    return G.adjacency(copurchase(spark, sf_dir)).select("id", F.array_join("adj", ",").alias("adj"))


@query
def vertex_degree(spark, sf_dir):
    return G.degrees(copurchase(spark, sf_dir))


@query
def triangle_count(spark, sf_dir):
    edges, scratch = _edges(spark, sf_dir)
    return T.corner_totals(edges, scratch)


def _support(spark: SparkSession, sf_dir: str, spent: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    """(src, dst) and (src, dst, support), both with src < dst, the second for edges with any. With spent the first is gone."""
    edges, scratch = _edges(spark, sf_dir)
    support = T.supports(edges, scratch, spent)[0].where("support > 0")
    scratch.release()
    return edges.where("src < dst"), support, scratch


@query
def edge_support(spark, sf_dir):
    return G.with_reverse(_support(spark, sf_dir, spent=True)[1])


@query
def pruned_edges(spark, sf_dir):
    return _pruned(spark, sf_dir)[0].edges


@query
def pruned_vertices(spark, sf_dir):
    return _pruned(spark, sf_dir)[0].vertices.select("id", "t", "vt")


@query
def clustering_coefficient(spark, sf_dir):
    return _pruned(spark, sf_dir)[0].vertices.select("id", r6("cc"))


@query
def global_cc(spark, sf_dir):
    p, _ = _pruned(spark, sf_dir)
    return p.vertices.agg(F.round(F.sum(F.round("cc", 12).cast("decimal(38,12)")).cast("double") / F.lit(p.vertex_count), 6).alias("omega"))


@query
def initial_partition_labels(spark, sf_dir):
    return _seeded(spark, sf_dir)[1].select("id", "cid")


@query
def community_centers(spark, sf_dir):
    return _seeded(spark, sf_dir)[1].where("center").select("id")


@query
def best_center_neighbor(spark, sf_dir):
    return _seeded(spark, sf_dir)[1].where("not center").select("id", "cid")


@query
def community_size(spark, sf_dir):
    return C.community_sizes(_seeded(spark, sf_dir)[1])


@query
def community_edges(spark, sf_dir):
    own = _state(spark, sf_dir)[2]
    return C.community_edges(own)


@query
def community_stats(spark, sf_dir):
    return _state(spark, sf_dir)[3].select("cid", "r", "a", "b", r6("d"))


@query
def community_add_remove(spark, sf_dir):
    """Each community after losing, and after gaining, a vertex with its b edges split evenly."""
    s = _state(spark, sf_dir)[3]
    r, a, b = F.col("r"), F.col("a"), F.col("b")
    k, o = F.expr("b div 2"), b - F.expr("b div 2")
    plus, minus = with_vertex(r, a, b, k, o), without_vertex(r, a, b, F.least(a, k), o)
    return s.select("cid", *(c.alias(f"{n}_add") for c, n in zip(plus, "rab", strict=True)), *(c.alias(f"{n}_remove") for c, n in zip(minus, "rab", strict=True)))


@query
def vertex_community_degree(spark, sf_dir):
    p, labels, _, _, scratch = _state(spark, sf_dir)
    return _degrees(p, labels, scratch)


@query
def community_neighbors(spark, sf_dir):
    p, seed, _ = _seeded(spark, sf_dir)
    return C.community_neighbors(p.edges, seed.select("id", "cid")).select("id", F.array_join("neighbors", ",").alias("neighbors"))


@query
def community_triangles(spark, sf_dir):
    p, seed, _ = _seeded(spark, sf_dir)
    return C.community_triangles(p.edges, seed.select("id", "cid"))


@query
def vertex_wcc(spark, sf_dir):
    p, labels, own, _, _ = _state(spark, sf_dir)
    return C.vertex_scores(p, labels, own).select("id", r6("wcc"))


@query
def global_wcc(spark, sf_dir):
    p, labels, own, _, _ = _state(spark, sf_dir)
    return C.global_wcc_sum(C.vertex_scores(p, labels, own)).select(F.round(F.col("s") / p.vertex_count, 6).alias("wcc"))


def _gains(spark, sf_dir):
    p, labels, own, stats, scratch = _state(spark, sf_dir)
    return p, labels, own, stats, scratch, F.lit(p.omega), F.lit(float(p.vertex_count))


@query
def wcc_insert_gain(spark, sf_dir):
    p, labels, own, stats, scratch, omega, v = _gains(spark, sf_dir)
    deg = _degrees(p, labels, scratch)
    g = R.insertion_gains(deg, R.removal_gains(own, stats, omega, v), stats, omega, v)
    return g.select("id", "cid", F.when(F.isnan("wcc_i"), None).otherwise(F.round(F.col("wcc_i") * 1e6, 3)).alias("wcc_i_millionths"))


@query
def wcc_remove_gain(spark, sf_dir):
    _, _, own, stats, _, omega, v = _gains(spark, sf_dir)
    return R.removal_gains(own, stats, omega, v).select("id", F.when(F.isnan("wcc_r"), None).otherwise(F.round(F.col("wcc_r") * 1e6, 3) + 0.0).alias("wcc_r_millionths"))


@query
def best_movement(spark, sf_dir):
    p, labels, own, stats, scratch = _state(spark, sf_dir)
    return R.movements(p, labels, own, stats, scratch).select("id", "move", "cid")


@query
def movement_round(spark, sf_dir):
    p, seed, scratch = _seeded(spark, sf_dir)
    return R.rounds(p, seed.select("id", "cid"), scratch, 1)


@query
def refined_partition(spark, sf_dir):
    return detect_communities(copurchase(spark, sf_dir)).labels


@query
def final_partition(spark, sf_dir):
    return detect_communities(copurchase(spark, sf_dir)).vertices.select("id", "cid")


@query
def stream_split(spark, sf_dir):
    edges, _, _, _, split, _ = _batch(spark, sf_dir)
    return edges.withColumn("part", F.when(F.greatest("src", "dst") < split, "bulk").otherwise("stream"))


@query
def micro_batches(spark, sf_dir):
    _, _, stream, largest, split, _ = _batch(spark, sf_dir)
    parts = [I.batch_edges(stream, lo, hi).withColumn("batch", F.lit(k).cast("long")) for k, (lo, hi) in enumerate(I.batch_ranges(largest, split, 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def border_vertices(spark, sf_dir):
    _, bulk, stream, *_ = _batch(spark, sf_dir)
    return I.border_vertices(G.Graph.from_edges(bulk).vertices, stream)


@query
def new_vertices(spark, sf_dir):
    _, bulk, stream, *_ = _batch(spark, sf_dir)
    return I.new_vertices(G.Graph.from_edges(bulk).vertices, stream)


@query
def merged_graph(spark, sf_dir):
    _, bulk, stream, *_ = _batch(spark, sf_dir)
    return G.Graph.from_edges(bulk).union(G.Graph.from_edges(stream)).edges


@query
def delta_triangle_stats(spark, sf_dir):
    edges, bulk, stream, *_, scratch = _batch(spark, sf_dir)
    p = prune(bulk, scratch, keep_triangles=False)
    return I.delta_stats(scratch.table(I.delta_triangles(edges, stream)), p.edges)


@query
def updated_vertices(spark, sf_dir):
    """Old vertices come with the labels id - id % 10, so that one sees which are reset."""
    edges, bulk, stream, *_, scratch = _batch(spark, sf_dir)
    p = prune(bulk, scratch, keep_triangles=False)
    v = G.Graph.from_edges(bulk).vertices.join(p.vertices, "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("vt", F.lit(0)).alias("vt"), (F.col("id") - F.col("id") % 10).alias("cid"))
    stats = I.delta_stats(scratch.table(I.delta_triangles(edges, stream)), p.edges)
    return I.updated_vertices(v, stream, stats).select("id", "t", "vt", r6("cc"), "cid")


@query
def incremental_partition(spark, sf_dir):
    return I.replay(copurchase(spark, sf_dir)).vertices.select("id", "cid")


@query
def edge_list_scan(spark, sf_dir):
    """The edges after a trip through an edge list file."""
    scratch = Scratch(spark, "edges")
    copurchase_pairs(spark, sf_dir).write.option("sep", " ").csv(f"{scratch.root}/list")
    return load_graph(spark, f"{scratch.root}/list").edges


@query
def csv_outputs(spark, sf_dir):
    """All outputs of a detection, written and read back: name, and fields as numbers."""
    scratch = Scratch(spark, "outputs")
    where = write_detection(detect_communities(copurchase(spark, sf_dir)), scratch.root)
    wide = {"triangle_counts": 3, "initial_community_stats": 4}
    out = None
    for name, path in where.items():
        n = wide.get(name, 2)
        t = spark.read.schema(", ".join(f"f{i} long" for i in range(n))).option("mode", "FAILFAST").csv(path)
        t = t.select(F.lit(name).alias("output"), *(F.col(f"f{i}") if i < n else F.lit(None).cast("long").alias(f"f{i}") for i in range(4)))
        out = t if out is None else out.unionByName(t)
    return out


@query
def incremental_output(spark, sf_dir):
    """The partition after all batches, written and read back."""
    scratch = Scratch(spark, "outputs")
    return spark.read.schema("id long, cid long").option("mode", "FAILFAST").csv(write_state(I.replay(copurchase(spark, sf_dir)), scratch.root))


@query
def vertex_update(spark, sf_dir):
    """Degrees, with the triangles added where a vertex has any."""
    edges, scratch = _edges(spark, sf_dir)
    g = G.Graph(G.degrees(edges), edges).map_vertices(x=F.col("degree"))
    return g.join_vertices(T.corner_totals(edges, scratch).where("t > 0"), {"x": F.col("x") + F.col("new_t")}).vertices


@query
def edge_attributes(spark, sf_dir):
    """Edges with the triangles of both ends; null where an end has none."""
    edges, scratch = _edges(spark, sf_dir)
    t = broadcast_if_small(T.corner_totals(edges, scratch).where("t > 0"))
    return G.Graph.from_edges(edges).join_edges_on("src", t, "t", "src_t").join_edges_on("dst", t, "t", "dst_t").edges


@query
def edge_update(spark, sf_dir):
    """Edges of weight 0, which becomes the support where an edge has any."""
    edges, support, scratch = _support(spark, sf_dir)
    g = G.Graph.from_edges(edges).map_edges(w=F.lit(0).cast("long"))
    return G.with_reverse(scratch.sliced(g.edges, "src", lambda e: replace(g, edges=e).join_edges(support, {"w": F.col("new_support")}).edges))


@query
def subgraph(spark, sf_dir):
    """Edges with an even sum of ends between vertices of more than average degree."""
    edges, scratch = _edges(spark, sf_dir)
    degree = scratch.table(G.degrees(edges))
    mean = F.lit(degree.agg(F.avg("degree")).first()[0])
    return G.Graph(degree, edges).subgraph(F.col("degree") > mean, (F.col("src") + F.col("dst")) % 2 == 0).edges


@query
def triplets(spark, sf_dir):
    edges, _ = _edges(spark, sf_dir)
    return G.Graph(G.degrees(edges), edges).triplets()


@query
def largest_reachable(spark, sf_dir):
    """Vertex-centric iteration: the largest id within four steps."""
    edges, _ = _edges(spark, sf_dir)
    g = G.Graph.from_edges(edges).map_vertices(best=F.col("id"))
    return g.pregel(F.col("src_best"), F.max, {"best": F.greatest("best", "message")}, 4, send=F.col("src_best") > F.col("dst_best")).vertices


def queries() -> dict[str, Query]:
    return dict(_FOUND)
