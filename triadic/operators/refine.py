"""Refinement: all vertices move at once from one snapshot, as long as global WCC rises."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.functions.metric import above, insert_gain, remove_gain
from triadic.operators.communities import community_degrees, community_stats, global_wcc, own_counts
from triadic.operators.prune import Pruned
from triadic.scratch import Scratch, broadcast_if_small

# A float32 0.01 widened, and the margin of a removal.
THRESHOLD = 0.009999999776482582
MARGIN = 1e-5


def removal_gains(own: DataFrame, stats: DataFrame, omega, v) -> DataFrame:
    """(id, own, d_all, wcc_r)"""
    s = stats.select(F.col("cid").alias("own"), "r", "a", "b")
    gain = remove_gain(F.col("r"), F.col("a"), F.col("b"), F.col("d_own"), F.col("d_all") - F.col("d_own"), omega, v)
    return own.join(s, "own").select("id", "own", "d_all", gain.alias("wcc_r"))


def insertion_gains(deg: DataFrame, removal: DataFrame, stats: DataFrame, omega, v) -> DataFrame:
    """(id, cid, wcc_i, gain): of each community next to a vertex with several members, and the gain together with leaving its own."""
    s = broadcast_if_small(stats.where("r > 1").select("cid", "r", "a", "b"))
    d = deg.join(removal, "id").where("cid <> own").join(s, "cid")
    wcc_i = insert_gain(F.col("r"), F.col("a"), F.col("b"), F.col("din"), F.col("d_all") - F.col("din"), omega, v)
    return d.select("id", "cid", wcc_i.alias("wcc_i"), "wcc_r").withColumn("gain", F.col("wcc_r") + F.col("wcc_i")).drop("wcc_r")


def best_movements(deg: DataFrame, own: DataFrame, stats: DataFrame, omega, v) -> DataFrame:
    """(id, own, wcc_r, wcc_t, move, cid) for each vertex with an edge; move is REMOVE, TRANSFER or STAY.

    Equal gains go to the smallest community id. NaN gains never win.
    """
    return chosen(removal_gains(own, stats, omega, v), best_targets(deg, own, stats, omega, v))


def best_targets(deg: DataFrame, own: DataFrame, stats: DataFrame, omega, v) -> DataFrame:
    """(id, wcc_t, target): the community of the highest gain, for vertices with any gain above 0."""
    removal = removal_gains(own, stats, omega, v)
    ins = insertion_gains(deg, removal, stats, omega, v).where(above(F.col("gain"), 0.0))
    return ins.groupBy("id").agg(F.max(F.struct("gain", (-F.col("cid")).alias("minus"))).alias("best")).select("id", F.col("best.gain").alias("wcc_t"), (-F.col("best.minus")).alias("target"))


def chosen(removal: DataFrame, best: DataFrame) -> DataFrame:
    """What best_movements returns, from the gains of leaving and the best targets."""
    m = removal.join(best, "id", "left").withColumn("wcc_t", F.coalesce("wcc_t", F.lit(0.0)))
    leave = above(F.col("wcc_r") - F.col("wcc_t"), MARGIN) & above(F.col("wcc_r"), 0.0)
    move = F.when(leave, "REMOVE").when(F.col("wcc_t") > 0, "TRANSFER").otherwise("STAY")
    m = m.withColumn("move", move)
    return m.select("id", "own", "wcc_r", "wcc_t", "move", F.when(F.col("move") == "REMOVE", F.col("id")).when(F.col("move") == "TRANSFER", F.col("target")).otherwise(F.col("own")).alias("cid"))


def snapshot(p: Pruned, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Degrees by community and own degrees of a partition, stored."""
    deg = scratch.sliced(p.edges, "src", lambda e: community_degrees(e, labels))
    return deg, stored_own(p, labels, scratch)


def stored_own(p: Pruned, labels: DataFrame, scratch: Scratch) -> DataFrame:
    own = scratch.table(own_counts(p, labels))
    scratch.release()
    return own


def movements(p: Pruned, labels: DataFrame, own: DataFrame, stats: DataFrame, scratch: Scratch) -> DataFrame:
    """best_movements of a partition, stored: own and stats are tables, and degrees by community, which are many, are made and used up in slices of vertices."""
    omega, v = F.lit(p.omega), F.lit(float(p.vertex_count))
    targets = lambda e: best_targets(community_degrees(e, labels), own, stats, omega, v)
    best = scratch.sliced(p.edges, "src", targets)
    out = scratch.table(chosen(removal_gains(own, stats, omega, v), best))
    scratch.drop(best)
    return out


def moved(p: Pruned, labels: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after one round of movements."""
    stats = scratch.table(community_stats(labels, own))
    m = movements(p, labels, own, stats, scratch)
    out = scratch.table(labels.select("id", "cid").join(m.select("id", F.col("cid").alias("new")), "id", "left").select("id", F.coalesce("new", "cid").alias("cid")))
    scratch.drop(stats, m)
    return out


@dataclass
class Refined:
    labels: DataFrame
    history: list[float]  # WCC of the seed, then of each round, the discarded one included
    accepted: int
    seconds: list[float] = field(default_factory=list)  # of each round


def refine(p: Pruned, labels: DataFrame, scratch: Scratch, max_retries: int = 5) -> Refined:
    """A round that doesn't raise WCC is discarded and ends the loop; one that raises it by
    more than the threshold restores the retries."""
    own = stored_own(p, labels, scratch)
    best = global_wcc(p, labels, own)
    history, seconds, retries, accepted = [best], [], max_retries, 0
    while retries > 0:
        began = time.time()
        new = moved(p, labels, own, scratch)
        new_own = stored_own(p, new, scratch)
        score = global_wcc(p, new, new_own)
        history.append(score)
        seconds.append(time.time() - began)
        retries -= 1
        if not score > best:
            break
        if best == 0 or score / best - 1 > THRESHOLD:
            retries = max_retries
        scratch.drop(own)
        labels, own, best, accepted = new, new_own, score, accepted + 1
    return Refined(labels, history, accepted, seconds)


def rounds(p: Pruned, labels: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Labels after exactly n rounds, without a test of WCC."""
    for _ in range(n):
        own = stored_own(p, labels, scratch)
        labels = moved(p, labels, own, scratch)
        scratch.drop(own)
    return labels
