"""Initial partition: the maximal independent set that is greedy in the rank (cc, vt, id), and who joins whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.operators.prune import Pruned
from triadic.scratch import Scratch, broadcast_if_small


def ranks(p: Pruned) -> DataFrame:
    """(id, rank)"""
    return p.vertices.select("id", F.struct("cc", "vt", "id").alias("rank"))


def upward_edges(edges: DataFrame, r: DataFrame) -> DataFrame:
    """(v, u): each undirected edge once, to the end of higher rank. r: (id, rank). Ids are in the edges already, so the shuffles carry only the rest of a rank."""
    of = lambda end: r.select(F.col("id").alias(end), F.col("rank.cc").alias(f"{end}_cc"), F.col("rank.vt").alias(f"{end}_vt"))
    e = edges.where("src < dst").join(of("src"), "src").join(of("dst"), "dst")
    rank = lambda end: F.struct(F.col(f"{end}_cc").alias("cc"), F.col(f"{end}_vt").alias("vt"), F.col(end).alias("id"))
    up = rank("dst") > rank("src")
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("u"))


def initial_partition(p: Pruned, scratch: Scratch, max_supersteps: int = 50) -> DataFrame:
    """(id, cid, center) for every vertex of the pruned graph.

    All start as centres; a vertex is a centre in the next round if no centre
    among its neighbours outranks it, until nothing changes. The others join
    their centre neighbour of the highest rank.

    A round reads up, in which the first one, before which all are centres, is made
    in slices; the blocked are broadcast as long as they are few.
    """
    r = ranks(p)
    up = scratch.sliced(p.edges, "src", lambda e: upward_edges(e, r))
    scratch.release()
    ids = p.vertices.select("id")
    blocked = None  # none at first: all are centres
    for _ in range(max_supersteps - 1):
        if blocked is None:
            new = scratch.sliced(up.select(F.col("v").alias("id")), "id", lambda e: e.distinct())
        else:
            e = up.join(broadcast_if_small(blocked).withColumnRenamed("id", "u"), "u", "left_anti")
            new = scratch.table(e.select(F.col("v").alias("id")).distinct())
        old, blocked = blocked, new
        if old is None:
            done = new.isEmpty()
        else:
            done = new.join(old, "id", "left_anti").isEmpty() and old.join(new, "id", "left_anti").isEmpty()
            scratch.drop(old)
        scratch.release()
        if done:
            break
    if blocked is None:
        return ids.select("id", F.col("id").alias("cid"), F.lit(True).alias("center"))
    best = up.join(broadcast_if_small(blocked).withColumnRenamed("id", "u"), "u", "left_anti").join(r.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.max_by("u", "rank").alias("cid"))
    joined = blocked.join(best, "id", "left").select("id", F.coalesce("cid", "id").alias("cid"), F.lit(False).alias("center"))
    return ids.join(blocked, "id", "left_anti").select("id", F.col("id").alias("cid"), F.lit(True).alias("center")).unionByName(joined)
