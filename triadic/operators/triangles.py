"""Triangles, found once each, and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.operators.graph import both_ways, with_reverse
from triadic.scratch import Scratch, slices


def _packed(v: np.ndarray) -> bytes:
    """What goes between tasks; shuffle files compress ids too little themselves. Ids go as differences, by bytes of one weight."""
    if v.dtype == np.int64:
        v = np.diff(v, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return v.size.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(v).reshape(-1), codec="zstd", asbytes=True)


def _unpacked(part: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(part[8:], int.from_bytes(part[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1)) if kind is np.int64 else raw.view(kind)


HEAVY = 256  # edges of a vertex from which on its degree counts for the orientation
GROUP_EDGES = 2_000_000  # directed edges of the vertices of a group
PACK_EDGES = 500_000  # edges that a task makes pieces of at once


def oriented(edges: DataFrame, deg: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """(x, y, r, fresh): each undirected edge once, from the end of lower (r, id), with r of y. r is the degree of a heavy vertex, 0 of others.

    So out-degrees stay below HEAVY or the square root of twice the edges, and
    only heavy vertices, which are few, are joined.
    """
    heavy = deg.where(F.col("d") >= HEAVY)
    small = heavy.limit(most_broadcast + 1).count() <= most_broadcast
    of = lambda end, r: (F.broadcast if small else lambda t: t)(heavy.select(F.col("id").alias(end), F.col("d").alias(r)))
    zero = lambda r: F.coalesce(r, F.lit(0)).cast("long").alias(r)
    e = edges.where("src < dst").join(of("src", "rs"), "src", "left").join(of("dst", "rd"), "dst", "left").select("src", "dst", zero("rs"), zero("rd"), "fresh")
    pick = lambda a, b, name: F.when(F.col("rs") <= F.col("rd"), F.col(a)).otherwise(F.col(b)).alias(name)
    return e.select(pick("src", "dst", "x"), pick("dst", "src", "y"), pick("rd", "rs", "r"), F.col("fresh").cast("long").alias("fresh"))


def triangles(edges: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """Triangles of symmetric edges, see _search. With ``keep`` they are a table there."""
    return _search(edges, keep)[0]


def supports(edges: DataFrame, scratch: Scratch, spent: bool = False) -> tuple[DataFrame, int]:
    """(src, dst, support) with src < dst for all symmetric edges, 0 for those of no triangle; and the number of vertices.

    Edges are counted where triangles are found, so triangles are not a table. What
    the groups count of an edge is added in slices. With ``spent`` all other tables
    of scratch go, edges too, as soon as they aren't needed here.
    """
    found, n = _search(edges, scratch, "edges", spent)
    out = scratch.sliced(found, "src", lambda e: e.repartition("src").groupBy("src", "dst").agg(F.sum("support").alias("support")).sortWithinPartitions("src", "dst"))
    scratch.drop(found)
    return out, n


def corner_totals(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, t) for every vertex of symmetric edges, 0 without triangles, as a table. A group adds up its vertices' counts, so triangles are not a table."""
    found = _search(edges, scratch, "corners")[0]
    out = scratch.table(found.groupBy("id").agg(F.expr("sum(twice) div 2").alias("t")))
    scratch.drop(found)
    return out


def _search(edges: DataFrame, keep: Scratch | None, count: str = "", spent: bool = False) -> tuple[DataFrame, int]:
    """(a, b, c) with a < b < c, once for each triangle of symmetric edges; with a column fresh, of those that hold an edge where it is true.

    No table of wedges is made. Vertices are dealt by ranges of ids into groups of
    about GROUP_EDGES edges. The out-neighbours of x, in one piece, go once to each
    group that holds one of them, and to that of x. There pairs (y, z) of them with
    y in the group are looked up among the edges out of the group. So what is
    shuffled are the edges times the groups that a vertex has neighbours in, which
    are few where ids that are near are neighbours, and never more than wedges.

    With ``keep`` triangles are a table there, and the pieces one until then, both made
    in slices, so that the two shuffles are not on disk at once. With ``count`` "edges" rows
    are (src, dst, support), src < dst: triangles of a group that hold the edge, for
    edges with any and, in one group each, all others. With "corners" they are (id, twice):
    of each vertex in a group, the sum of that over its edges. Also returns the number of
    vertices. With ``spent`` all tables of keep go once the pieces are made.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "triangles")
    edges = edges.select("src", "dst", (F.col("fresh") if "fresh" in edges.columns else F.lit(True)).alias("fresh"))
    rows = edges.count() if keep is not None else 0
    deg = scratch.sliced(edges.select(F.col("src").alias("id")), "id", lambda e: e.groupBy("id").agg(F.count(F.lit(1)).alias("d")), rows)
    total, n = deg.agg(F.sum("d"), F.count(F.lit(1))).first()
    k = -(-(total or 0) // GROUP_EDGES) or 1
    weight = F.ceil(F.col("d") / F.lit(max(1.0, (total or 0) / max(n, 1)))).cast("int")
    cuts = deg.select("id", F.explode(F.sequence(F.lit(1), weight))).agg(F.percentile_approx("id", [i / k for i in range(1, k)], 100 * k)).first()[0] if k > 1 else []
    scratch.release()
    bounds = np.unique(np.asarray(cuts or [], np.int64))

    def pack(batches):
        """Rows (x, y, r, fresh) of whole vertices to (g, x, n, y, fresh): for a group, vertices, how many out-neighbours each has, and those by rank."""
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        x, y, r, fresh = (np.concatenate([b[i] for b in got] or [np.empty(0, np.int64)]) for i in range(4))
        del got
        order = np.lexsort((y, r, x))
        x, y, fresh = x[order], y[order], fresh[order].astype(bool)
        at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
        size, head = np.diff(np.append(at, len(x))), x[at]
        m = len(bounds) + 1
        each = np.repeat(np.arange(len(at)), size) * m + np.searchsorted(bounds, y, "right")
        to = np.unique(np.append(each, np.arange(len(at)) * m + np.searchsorted(bounds, head, "right")))
        g, who = to % m, to // m
        order = np.argsort(g, kind="stable")
        g, who = g[order], who[order]
        cut = np.searchsorted(g, np.arange(m + 1))
        for i in np.flatnonzero(np.diff(cut)):
            for lo in range(cut[i], cut[i + 1], 5_000):
                w = who[lo : min(lo + 5_000, cut[i + 1])]
                c = size[w]
                row = np.arange(c.sum()) + np.repeat(at[w] - np.cumsum(c) + c, c)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([_packed(v)], pa.binary()) for v in (head[w], c, y[row], fresh[row]))], names=["g", "x", "n", "y", "fresh"])

    def found(g, rows, most=1 << 18):
        """Triangles whose middle vertex by rank is in group g, in arrays of three columns. Of all arrays as long as the lists, only narrow ones are kept."""
        x, size, fresh = (np.concatenate([_unpacked(r[i], kind) for r in rows]) for i, kind in ((0, np.int64), (1, np.int64), (3, bool)))
        ids = np.unique(np.concatenate([np.unique(_unpacked(r[2], np.int64)) for r in rows]))
        at = np.concatenate([np.searchsorted(ids, _unpacked(r[2], np.int64)).astype(np.int32) for r in rows])
        own = np.searchsorted(bounds, x, "right") == g
        #: edges out of the group as numbers: place of the end in ids, by that of the vertex among the group's
        mine = np.sort(x[own])
        if not len(mine):
            return
        end_of = np.cumsum(size)
        whose = np.repeat(np.arange(len(x), dtype=np.int32), size)
        place_of = np.flatnonzero(own[whose]).astype(np.int32)
        key = np.searchsorted(mine, x)[whose[place_of]] * len(ids) + at[place_of]
        order = np.argsort(key)
        key, place_of = key[order], place_of[order]
        del order
        times = np.zeros(len(at), np.int32)
        bits = max(10, int(len(key)).bit_length() + 3)
        hashed = lambda v: (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        for lo in range(0, len(key), most):
            seen[hashed(key[lo : lo + most])] = True
        #: of each id the place among the group's vertices with edges out, -1 for others
        place = np.minimum(np.searchsorted(mine, ids), len(mine) - 1)
        place = np.where((mine[place] == ids) & (np.searchsorted(bounds, ids, "right") == g), place, -1)
        mid = np.flatnonzero(place[at] >= 0).astype(np.int32)
        after = (end_of[whose[mid]] - mid - 1).astype(np.int32)
        total = np.cumsum(after, dtype=np.int64)
        lo = 0
        while lo < len(mid):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
            c = after[lo:hi].astype(np.int64)
            upto = np.cumsum(c)
            first = np.repeat(mid[lo:hi] + 1 - upto + c, c)
            first += np.arange(len(first))
            pair = np.repeat(place[at[mid[lo:hi]]] * len(ids), c) + at[first]
            may = np.flatnonzero(seen[hashed(pair)])
            edge = np.minimum(np.searchsorted(key, pair[may]), len(key) - 1)
            hit = key[edge] == pair[may]
            may, edge = may[hit], place_of[edge[hit]]
            m, z = mid[lo:hi][np.searchsorted(upto, may, "right")], first[may]
            new = fresh[m] | fresh[z] | fresh[edge]
            m, z, edge = m[new], z[new], edge[new]
            if count:
                for e in (m, z, edge):
                    np.add.at(times, e, np.int32(1))
            else:
                yield np.sort(np.stack([x[whose[m]], ids[at[m]], ids[at[z]]], axis=1), axis=1)
            lo = hi
        if count == "corners":
            who, back = np.unique(np.concatenate([x, ids]), return_inverse=True)
            twice = np.bincount(back[: len(x)], np.add.reduceat(times, end_of - size, dtype=np.int64), len(who)) + np.bincount(back[len(x) :], np.bincount(at, times, len(ids)), len(who))
            yield np.stack([who, twice.astype(np.int64)], axis=1)
        elif count:
            del seen, key, place_of, mid, after, total
            for lo in range(0, len(at), 100_000):
                some = lo + np.flatnonzero((times[lo : lo + 100_000] > 0) | own[whose[lo : lo + 100_000]])
                ends = np.sort(np.stack([x[whose[some]], ids[at[some]]], axis=1), axis=1)
                yield np.concatenate([ends, times[some, None].astype(np.int64)], axis=1)

    def close(batches):
        rows, group = [], None
        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group and rows:
                    yield from out(found(group, rows))
                    rows = []
                group = g
                rows.append(row)
        if rows:
            yield from out(found(group, rows))

    def out(parts):
        for t in parts:
            for lo in range(0, len(t), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[lo : lo + 100_000, i])) for i in range(len(names))], names=names)

    names = {"edges": ["src", "dst", "support"], "corners": ["id", "twice"]}.get(count, ["a", "b", "c"])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(bounds) + 1)
    kind = "g int, x binary, n binary, y binary, fresh binary"
    lists = oriented(edges, deg)
    if keep is None:
        lists = lists.repartition(tasks, "x").mapInArrow(pack, kind)
    else:
        each = max(-(-tasks // slices(rows // 2)), -(-rows // 2 // slices(rows // 2) // PACK_EDGES))
        lists = scratch.sliced(lists, "x", lambda e: e.repartition(each, "x").mapInArrow(pack, kind), rows // 2)
        scratch.release()
    to = ", ".join(f"{c} long" for c in names)
    if keep is None:
        return lists.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(close, to), n
    if spent:
        keep.retain()
    each = -(-2 * tasks // min(4, slices(rows // 2)))
    result = keep.sliced(lists, "g", lambda e: e.repartition(each, "g").sortWithinPartitions("g").mapInArrow(close, to), rows // 2, most=4)
    scratch.close()
    keep.release()
    return result, n


def corner_counts(tri: DataFrame, name: str = "t") -> DataFrame:
    """(id, t): triangles through each vertex that has any."""
    return tri.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias(name))


def triangle_counts(vertices: DataFrame, tri: DataFrame) -> DataFrame:
    """(id, t) for every vertex, 0 without triangles."""
    return vertices.select("id").join(corner_counts(tri), "id", "left").select("id", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def closed_pairs(tri: DataFrame) -> DataFrame:
    """(src, dst): the edges of each triangle, src < dst."""
    ends = [("a", "b"), ("a", "c"), ("b", "c")]
    return tri.select(F.explode(F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ends))).alias("e")).select("e.src", "e.dst")


def edge_support(tri: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(src, dst, support): triangles that each directed edge closes, for edges with any. Counted for undirected ones, then given for both directions.

    With a scratch, those of undirected edges are a table there, made in slices.
    """
    count = lambda e: e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support"))
    pairs = closed_pairs(tri)
    return both_ways(count(pairs)) if scratch is None else with_reverse(scratch.sliced(pairs, "src", count))
