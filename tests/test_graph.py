"""Hand-checked graphs, invariants on random graphs, and the loop's exits."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from triadic.functions import metric as M
from triadic.operators import communities as C
from triadic.operators import incremental as I
from triadic.operators.detect import detect_communities
from triadic.operators.graph import Graph, adjacency, degrees, symmetrize
from triadic.operators.prune import Pruned, prune
from triadic.operators.refine import best_movements, snapshot
from triadic.operators.seed import initial_partition, ranks, upward_edges
from triadic.operators.triangles import corner_counts, edge_support, triangles
from triadic.scratch import Scratch

K = lambda *v: list(itertools.combinations(v, 2))
GRAPHS = {
    "pendant": ([(1, 2), (2, 3), (1, 3), (3, 4)], {1: 1, 2: 1, 3: 1}, {1: 3, 2: 3, 3: 3}, 0.75, [0.75, 0.75], {1: 3, 2: 3, 3: 3, 4: 4}),
    "bow_tie": ([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5)], {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}, {1: 2, 2: 2, 3: 5, 4: 5, 5: 5}, 0.866667, [0.5, 0.5], {1: 2, 2: 2, 3: 5, 4: 5, 5: 5}),
    "two_k4": (K(1, 2, 3, 4) + K(5, 6, 7, 8) + [(4, 5)], dict.fromkeys(range(1, 9), 3), {**dict.fromkeys(range(1, 5), 4), **dict.fromkeys(range(5, 9), 8)}, 1.0, [1.0, 1.0], {**dict.fromkeys(range(1, 5), 4), **dict.fromkeys(range(5, 9), 8)}),
    "diamond": ([(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)], {1: 1, 2: 2, 3: 2, 4: 1}, {1: 1, 2: 4, 3: 4, 4: 4}, 0.833333, [0.5, 0.833333, 0.833333], dict.fromkeys(range(1, 5), 4)),
}


def edges_of(spark, pairs):
    return symmetrize(spark.createDataFrame(pairs, "src long, dst long"))


def as_dict(df, value, key="id"):
    return {r[key]: r[value] for r in df.select(key, value).collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_golden(spark, name):
    pairs, t, seed, omega, history, final = GRAPHS[name]
    d = detect_communities(edges_of(spark, pairs))
    assert as_dict(d.pruned.vertices, "t") == t
    assert as_dict(d.seed, "cid") == seed
    assert round(d.metrics["omega"], 6) == omega
    assert [round(x, 6) for x in d.metrics["wcc_history"]] == history
    assert as_dict(d.vertices, "cid") == final


def test_loops_repeats_and_empty(spark):
    e = edges_of(spark, [(1, 1), (1, 2), (2, 1), (1, 2)])
    assert sorted(map(tuple, e.collect())) == [(1, 2), (2, 1)]
    d = detect_communities(edges_of(spark, [(7, 7)]))
    assert d.vertices.count() == 0 and d.metrics["wcc_history"] == [0.0, 0.0]
    d = detect_communities(edges_of(spark, [(1, 2), (2, 3)]))  # no triangle
    assert as_dict(d.vertices, "cid") == {1: 1, 2: 2, 3: 3}


MORE = {  # fixtures F3 and F6
    "k4": (K(1, 2, 3, 4), dict.fromkeys(range(1, 5), 3), dict.fromkeys(range(1, 5), 4), 1.0, [1.0, 1.0], dict.fromkeys(range(1, 5), 4)),
    "k5_k4": (K(1, 2, 3, 4, 5) + K(4, 5, 6, 7)[1:], {1: 6, 2: 6, 3: 6, 4: 9, 5: 9, 6: 3, 7: 3}, {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 7, 7: 7}, 0.885714, [0.619048, 0.619048], {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 7, 7: 7}),
}


@pytest.mark.parametrize("name", MORE)
def test_golden_cliques(spark, name):
    pairs, t, seed, omega, history, final = MORE[name]
    d = detect_communities(edges_of(spark, pairs))
    assert as_dict(d.pruned.vertices, "t") == t and as_dict(d.seed, "cid") == seed and as_dict(d.vertices, "cid") == final
    assert round(d.metrics["omega"], 6) == omega and [round(x, 6) for x in d.metrics["wcc_history"]] == history


def copurchase_of(spark, sf, mod):
    items = spark.read.parquet(f"/root/testdata/{sf}/lineitem.parquet").where(F.col("l_orderkey") % mod == 0).select("l_orderkey", "l_partkey").distinct()
    return symmetrize(items.join(items.withColumnRenamed("l_partkey", "dst"), "l_orderkey").select(F.col("l_partkey").alias("src"), "dst"))


@pytest.mark.parametrize(("mod", "vertices", "seeds", "history"), [
    (8, 193, 48, [0.230280, 0.285055, 0.294252, 0.290809]), (32, 117, 34, [0.448555, 0.467050, 0.467050]),
])
def test_histories(spark, mod, vertices, seeds, history):
    """A round that lowers WCC, and one that leaves it, end the loop and are discarded."""
    d = detect_communities(copurchase_of(spark, "sf0.001", mod))
    assert d.metrics["vertices"] == vertices and d.seed.where("center").count() == seeds
    assert [round(x, 6) for x in d.metrics["wcc_history"]] == history and d.metrics["rounds_accepted"] == len(history) - 2
    assert len(d.metrics["seconds"]["rounds"]) == len(history) - 1


def test_retries_are_spent(spark):
    """The other exit: rounds that raise WCC too little use up the retries."""
    d = detect_communities(copurchase_of(spark, "sf0.01", 8), max_retries=2)
    h = d.metrics["wcc_history"]
    assert [round(x, 6) for x in h] == [0.233259, 0.259940, 0.268916, 0.274479, 0.276787, 0.277976] and d.metrics["rounds_accepted"] == 5
    assert h[4] / h[3] - 1 < 0.01 and h[5] > h[4]


def random_pairs(seed, n=16, p=0.35):
    r = random.Random(seed)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < p]


def brute(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    t = {v: sum(1 for a, b in itertools.combinations(sorted(adj[v]), 2) if b in adj[a]) for v in adj}
    vt = {v: sum(1 for u in adj[v] if adj[u] & adj[v]) for v in adj}
    return adj, {v: x for v, x in t.items() if x}, {v: vt[v] for v in t if t[v]}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    pairs = random_pairs(seed)
    adj, t, vt = brute(pairs)
    e = edges_of(spark, pairs).cache()
    tri = triangles(e).cache()
    assert as_dict(corner_counts(tri), "t") == t
    assert sum(t.values()) == 3 * tri.count()
    assert {(r["src"], r["dst"]): r["support"] for r in edge_support(tri).collect()} == {(a, b): len(adj[a] & adj[b]) for a in adj for b in adj[a] if adj[a] & adj[b]}
    assert as_dict(adjacency(e), "adj") == {v: sorted(x) for v, x in adj.items()}
    assert as_dict(degrees(e), "degree") == {v: len(x) for v, x in adj.items()}
    scratch = Scratch(spark, "t")
    p = prune(e, scratch)
    assert as_dict(p.vertices, "vt") == vt
    seed_ = initial_partition(p, scratch)
    cid, center = as_dict(seed_, "cid"), as_dict(seed_, "center")
    sup = {(r["src"], r["dst"]) for r in p.edges.collect()}
    assert not any(center[a] and center[b] for a, b in sup)  # independent
    assert all(center[v] or center[cid[v]] for v in cid)  # dominating
    deg, own = snapshot(p, seed_.select("id", "cid"), scratch)
    s = C.community_stats(seed_, own)
    got = s.agg(F.sum("r"), F.sum("b"), F.sum("a")).first()
    assert got[0] == len(t) and got[1] % 2 == 0 and got[2] + got[1] // 2 == len(sup) // 2
    moves = best_movements(deg, own, s, F.lit(p.omega), F.lit(float(p.vertex_count))).collect()
    assert {m["id"] for m in moves} == set(t) and all((m["move"] == "STAY") == (m["cid"] == m["own"]) or m["move"] == "REMOVE" for m in moves)


def test_division_and_comparison(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0)], "n double, d double")
    got = [r[0] for r in rows.select(M.ieee_div(F.col("n"), F.col("d"))).collect()]
    assert got[:3] == [0.5, math.inf, -math.inf] and math.isnan(got[3])
    assert [r[0] for r in rows.select(M.above(M.ieee_div(F.col("n"), F.col("d")), 0.0)).collect()] == [True, True, False, False]


def test_split_point_is_float32():
    assert I.split_point(99_999_999) == 80_000_000
    assert [I.split_point(x) for x in (199, 1999, 19_999)] == [159, 1599, 15_999]
    assert I.batch_ranges(99, 79, 3) == [(79, 85), (85, 91), (91, 100)]


@pytest.mark.parametrize("by_vertex", [True, False])
def test_absorbed_counts_equal_recount(spark, by_vertex):
    pairs = random_pairs(7, 18, 0.3)
    r = random.Random(3)
    old = [x for x in pairs if (max(x) < 13 if by_vertex else r.random() < 0.6)]
    state = I.bootstrap(edges_of(spark, old))
    batch = spark.createDataFrame([x for x in pairs if x not in old], "src long, dst long")
    state = I.absorb(state, batch, n_rounds=1)
    _, t, vt = brute(pairs)
    live = state.vertices.where("t > 0")
    assert as_dict(live, "t") == t and as_dict(live, "vt") == vt
    again = I.absorb(state, batch, n_rounds=1)
    assert as_dict(again.vertices, "t") == as_dict(state.vertices, "t")
    known = {v for x in old for v in x}
    touched = {v for x in pairs if x not in old for v in x}
    m, a = state.metrics, again.metrics
    assert (m["vertices"], m["new_edges"], m["border_vertices"], m["new_vertices"]) == (len(known | touched), len(pairs) - len(old), len(known & touched), len(touched - known))
    assert m["new_triangles"] == sum(t.values()) // 3 - sum(brute(old)[1].values()) // 3 and a["new_edges"] == a["new_triangles"] == a["new_vertices"] == 0
    assert m["wcc"] == a["wcc"] > 0 and set(m["seconds"]) == {"merge", "seed", "rounds"}


def test_labels_before_a_batch_do_not_matter(spark):
    """What lets replay leave the bulk unrefined."""
    pairs = random_pairs(11, 20, 0.3)
    old, batch = edges_of(spark, [x for x in pairs if max(x) < 15]), spark.createDataFrame([x for x in pairs if max(x) >= 15], "src long, dst long")
    a, b = I.absorb(I.bootstrap(old), batch, 2), I.absorb(I.counted(old), batch, 2)
    assert sorted(map(tuple, a.vertices.collect())) == sorted(map(tuple, b.vertices.collect()))


def test_graph_updates(spark):
    g = Graph.from_pairs(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).map_vertices(x=F.col("id") * 10)
    g2 = g.join_vertices(spark.createDataFrame([(2, 5)], "id long, x long"), {"x": F.col("x") + F.col("new_x")})
    assert as_dict(g2.vertices, "x") == {1: 10, 2: 25, 3: 30}
    assert g.subgraph(vertex=F.col("id") < 3).undirected_count() == 1
    assert {(r["src_x"], r["dst_x"]) for r in g.triplets().collect()} == {(10, 20), (20, 10), (20, 30), (30, 20)}
    e = g.join_edges_on("src", g.vertices, "x", "sx").edges.where("src = 3").first()
    assert e["sx"] == 30
    w = g.map_edges(w=F.lit(1)).join_edges(spark.createDataFrame([(1, 2, 9)], "src long, dst long, w int"), {"w": F.col("new_w")})
    assert sorted(r["w"] for r in w.edges.collect()) == [1, 1, 1, 9]
    far = g.pregel(F.col("src_x"), F.max, {"x": F.greatest("x", "message")}, 5)
    assert as_dict(far.vertices, "x") == {1: 30, 2: 30, 3: 30}


def test_queries_read_all_orders(spark, tmp_path):
    from triadic.plans.queries import queries

    r = random.Random(5)
    items = sorted({(o, p) for o in range(1, 41) for p in r.sample(range(1, 31), 3)})
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    pairs = {(a, b) for o, a in items for q, b in items if o == q and a < b}
    adj, t, vt = brute(pairs)
    q = queries()
    assert {tuple(x) for x in q["edges_symmetrized"](spark, str(tmp_path)).collect()} == pairs | {(b, a) for a, b in pairs}
    assert as_dict(q["triangle_count"](spark, str(tmp_path)), "t") == {v: t.get(v, 0) for v in adj}
    assert as_dict(q["pruned_vertices"](spark, str(tmp_path)), "vt") == vt
    assert as_dict(q["updated_vertices"](spark, str(tmp_path)), "t") == {v: t.get(v, 0) for v in adj}


@pytest.mark.parametrize(("heavy", "group_edges"), [(256, 2_000_000), (3, 20), (256, 7), (6, 1)])
def test_triangles_by_groups(spark, monkeypatch, heavy, group_edges):
    """Many groups, ids far apart and negative, heavy vertices: every triangle once, and those with a new edge."""
    from triadic.operators import triangles as T

    monkeypatch.setattr(T, "HEAVY", heavy)
    monkeypatch.setattr(T, "GROUP_EDGES", group_edges)
    name = lambda v: (v - 5) * 10**15 if v % 3 else v
    pairs = [(name(a), name(b)) for a, b in random_pairs(5, 24, 0.4)] + [(10**17, name(v)) for v in range(24)]
    all_edges = {frozenset(p) for p in pairs}
    ids = sorted({v for p in pairs for v in p})
    want = {t for t in itertools.combinations(ids, 3) if all(frozenset(p) in all_edges for p in itertools.combinations(t, 2))}
    e = edges_of(spark, pairs)
    got = [tuple(r) for r in triangles(e).collect()]
    assert len(got) == len(want) and set(got) == want
    new = {frozenset(p) for p in pairs[::9]}
    got = [tuple(r) for r in I.delta_triangles(e, edges_of(spark, pairs[::9])).collect()]
    want = {t for t in want if any(frozenset(p) in new for p in itertools.combinations(t, 2))}
    assert len(got) == len(want) and set(got) == want


def test_no_table_of_wedges(spark):
    """A star without triangles has the square of its edges in wedges at its middle; none is shuffled, and nothing is joined but degrees."""
    e = edges_of(spark, [(0, i) for i in range(1, 50)])
    tri = triangles(e)
    assert tri.count() == 0
    plan = tri._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan


def test_slices_change_no_result(spark, monkeypatch):
    """Support, pruning, seed and degrees by community made in several slices, and in one; each table of slices is whole."""
    import random

    from triadic import scratch as S
    from triadic.operators import graph, prune, refine, seed, triangles

    r = random.Random(3)
    pairs = spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(300)], "src long, dst long")
    edges = graph.symmetrize(pairs).localCheckpoint()

    def results():
        s = S.Scratch(spark, "t")
        p = prune.prune(edges, s)
        labels = s.table(seed.initial_partition(p, s))
        deg, own = refine.snapshot(p, labels.select("id", "cid"), s)
        support = triangles.edge_support(triangles.triangles(edges, s), s)
        return [sorted(map(tuple, t.collect())) for t in (p.edges, p.vertices, labels, deg, own, support)]

    once = results()
    monkeypatch.setattr(S, "SLICE_ROWS", 50)
    assert results() == once and all(once)


def test_no_table_of_triangles(spark, tmp_path, monkeypatch):
    """In a clique triangles outnumber edges by far; pruned_edges and edge_update store no table of them."""
    from triadic import scratch as S
    from triadic.plans import queries as P

    spark.createDataFrame([(1, i) for i in range(40)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    most, table, sliced = [], S.Scratch.table, S.Scratch.sliced
    monkeypatch.setattr(S.Scratch, "table", lambda self, *a, **k: most.append((t := table(self, *a, **k)).count()) or t)
    monkeypatch.setattr(S.Scratch, "sliced", lambda self, *a, **k: most.append((t := sliced(self, *a, **k)).count()) or t)
    assert P.queries()["pruned_edges"](spark, str(tmp_path)).count() == 40 * 39
    assert {r["w"] for r in P.queries()["edge_update"](spark, str(tmp_path)).collect()} == {38}
    assert max(most) <= 40 * 39 < math.comb(40, 3)


def test_shortcuts_equal_whole_computation(spark, monkeypatch):
    """Supports without triangles, own degrees without those by community, movements by slices, and all of it without broadcasts."""
    from triadic import scratch as S
    from triadic.operators import refine as R
    from triadic.operators.triangles import supports

    rows = lambda t: sorted(map(tuple, t.collect()))
    pairs = random_pairs(11, 30, 0.3)
    adj, t, _ = brute(pairs)
    for slice_rows, broadcast in ((4_000_000, 1_500_000), (100, 0)):
        monkeypatch.setattr(S, "SLICE_ROWS", slice_rows)
        monkeypatch.setattr(S, "MOST_BROADCAST", broadcast)
        s = S.Scratch(spark, "t")
        edges = s.table(edges_of(spark, pairs))
        found, n = supports(edges, s)
        assert n == len(adj) and rows(found) == sorted((a, b, len(adj[a] & adj[b])) for a in adj for b in adj[a] if a < b)
        p = prune(edges, s, keep_triangles=False)
        assert p.triangles is None and as_dict(p.vertices, "t") == t
        seed = s.table(initial_partition(p, s))
        labels = seed.select("id", "cid")
        deg, own = snapshot(p, labels, s)
        assert rows(own) == rows(C.own_degrees(deg, labels))
        stats = s.table(C.community_stats(labels, own))
        whole = best_movements(deg, own, stats, F.lit(p.omega), F.lit(float(p.vertex_count)))
        assert rows(R.movements(p, labels, own, stats, s)) == rows(whole)


def test_upward_edges_shuffle_no_id_twice(spark):
    rng = random.Random(11)
    rows = [(i, 1, rng.choice([2, 3]), rng.choice([0.25, 0.5])) for i in range(12)]
    pairs = list(itertools.combinations(range(12), 2))
    rank = {i: (cc, vt, i) for i, _, vt, cc in rows}
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    vertices = spark.createDataFrame(rows, "id long, t long, vt long, cc double")
    up = upward_edges(edges, ranks(Pruned(vertices, edges, None, 12)))
    assert sorted(map(tuple, up.collect())) == sorted(tuple(sorted(e, key=rank.get)) for e in pairs)
    joined = up._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "struct" not in joined  # what joins take from their sides is numbers alone


def test_triangles_are_counted_in_slices(spark, monkeypatch):
    """Counts of edges and vertices by several groups in several slices; with spent, what they came from is gone; and ids between tasks are short."""
    import os

    import numpy as np

    from triadic import scratch as S
    from triadic.operators import triangles as T

    monkeypatch.setattr(T, "GROUP_EDGES", 300)
    monkeypatch.setattr(S, "SLICE_ROWS", 200)
    rng = random.Random(11)
    pairs = {tuple(sorted((a, b + 10**12))) for a, b in itertools.product(range(0, 90, 3), range(0, 90, 2)) if rng.random() < 0.2}
    pairs |= {(a, b) for a, b in itertools.combinations(range(0, 90, 3), 2) if rng.random() < 0.4} | {(-7, 5), (-7, -2)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    scratch = S.Scratch(spark, "t")
    edges = scratch.table(spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long"))
    totals = {r["id"]: r["t"] for r in T.corner_totals(edges, scratch).collect()}
    assert totals == {v: sum(b in near[a] for a, b in itertools.combinations(n, 2)) for v, n in near.items()}
    support, n = T.supports(edges, scratch, spent=True)
    assert n == len(near) and {(r[0], r[1]): r[2] for r in support.collect()} == {(a, b): len(near[a] & near[b]) for a, b in pairs}
    assert [f"{scratch.root}/{x}" for x in os.listdir(scratch.root)] == [support._scratch_path]
    ids = np.sort(np.random.default_rng(1).integers(10**12, 10**12 + 5_000_000, 50_000))
    assert len(T._packed(ids)) < 1.5 * len(ids) and (T._unpacked(T._packed(ids), np.int64) == ids).all()


def test_items_of_orders_are_shuffled_in_slices(spark, monkeypatch, tmp_path):
    """No shuffle carries all items, and the pairs are the same; null orders and parts have none."""
    from triadic import scratch as S
    from triadic.sources.edge_list import copurchase_pairs, stored_pairs

    rng = random.Random(4)
    rows = [(rng.randrange(150), rng.randrange(40)) for _ in range(600)] + [(None, 1), (None, 2), (3, None), (151, 7), (151, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(S, "SLICE_ROWS", 100)
    made = []
    release = Scratch.release
    monkeypatch.setattr(Scratch, "release", lambda self: (made.append(1), release(self)))
    scratch = Scratch(spark, "t")
    got = stored_pairs(spark, str(tmp_path), scratch)
    assert len(made) >= 7 + S.slices(got.count())  # of items, then of pairs
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, copurchase_pairs(spark, str(tmp_path)).collect()))
