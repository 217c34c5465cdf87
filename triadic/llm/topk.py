"""Exact top-k by inner product: vectors in order of length, with SVD-rotated partial sums.

Vectors are dealt into blocks in descending order of length. A query first meets
the block of the longest vectors, which gives it a lower bound for its k-th
score; of the other blocks it visits those whose longest vector could still
reach that (Cauchy-Schwarz). Inside a block, candidates again come by descending
length, so a query leaves it as soon as length times length is too small; the
first coordinates after rotation by the singular vectors give a partial sum, and
the lengths of what is left bound the rest. Pairs whose bound is too small are
not multiplied out, unless so few are ruled out that one product of matrices is
cheaper than picking. On vectors of equal length, blocks are not pruned: every
query then visits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triadic.llm.common import Scratch, partitions, ship

_STEP = 512  # candidates that share one bound on length
DENSE = 8  # a picked pair costs as much as so many in a product of matrices
QUERIES = 32_768  # of a block, in one task


def _matrix(c: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), "<f8").reshape(-1, dim)


def scaled(df: DataFrame, id_col: str, vector_col: str, scale: float, dim: int) -> DataFrame:
    """Rows (id, length, v): floor(scale x) in double precision; vectors that are null or hold null or non-finite components are left out."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            keep, rows = [], []
            for i, v in enumerate(b.column(1).to_pylist()):
                if v is None or any(x is None for x in v):
                    continue
                a = np.asarray(v, np.float64)
                if not np.isfinite(a).all():
                    continue
                a = np.floor(scale * a)
                keep.append(i)
                rows.append(np.pad(a, (0, dim - len(a))))
            m = np.asarray(rows, "<f8").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(np.sqrt((m * m).sum(1))), pa.array([r.tobytes() for r in m], pa.binary())], names=["id", "length", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), vector_col).where(F.col("id").isNotNull()).mapInArrow(run, "id long, length double, v binary")


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of all rows, and how many of them hold three fifths of the energy.

    From the sum of outer products: dim x dim numbers reach the driver.
    """

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim)
            total += m.T @ m
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    g = np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    scale = np.abs(g).max() or 1.0
    values, vectors_ = np.linalg.eigh(g / scale)
    values, r = np.maximum(values[::-1], 0), vectors_[:, ::-1]
    share = np.cumsum(values) / (values.sum() or 1.0)
    return np.ascontiguousarray(r), min(dim, int(np.searchsorted(share, 0.6)) + 1)


def exact_scores(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of whole numbers; in doubles where those can't round."""
    if most < 2**52:
        return np.rint(q @ c.T).astype(np.int64)
    return (q.astype(object) @ c.T.astype(object)).astype(np.int64)


def picked_scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, most: float) -> np.ndarray:
    """The same of the pairs of rows (i, j) alone."""
    if most >= 2**52:
        return np.asarray([int(q[x].astype(object) @ c[y].astype(object)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = np.einsum("ij,ij->i", q[i[s]], c[j[s]])
    return np.rint(out).astype(np.int64)


class Block:
    """Candidates by descending length, ready for batches of queries."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rot: np.ndarray, h: int):
        length = np.sqrt((v * v).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length, self.rot, self.h = ids[order], v[order], length[order], rot, h
        r = self.v @ rot
        self.lead, self.rest = np.ascontiguousarray(r[:, :h]), np.sqrt((r[:, h:] ** 2).sum(1))
        self.pairs = self.products = 0  # that a bound couldn't rule out; that were multiplied out

    def top(self, qid: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score) of the up to k best of each query with scores >= least."""
        r = q @ self.rot
        lead, rest, length = r[:, : self.h], np.sqrt((r[:, self.h :] ** 2).sum(1)), np.sqrt((q * q).sum(1))
        bar = least.astype(float).copy()
        rows, ids, scores = (np.empty(0, np.int64) for _ in range(3))
        for at in range(0, len(self.ids), _STEP):
            s = slice(at, at + _STEP)
            slack = 1e-9 * length * self.length[at] + 1e-6
            live = np.flatnonzero(length * self.length[at] + slack >= bar)
            if not len(live):
                break
            bound = lead[live] @ self.lead[s].T + rest[live, None] * self.rest[None, s]
            may = bound + slack[live, None] >= bar[live, None]
            i, j = np.nonzero(may & (qid[live, None] != self.ids[None, s]))
            if not len(i):
                continue
            self.pairs += len(i)
            most = float(length.max() * self.length[at])
            if DENSE * len(i) < may.size:
                exact = picked_scores(q[live], self.v[s], i, j, most)
                self.products += len(i)
            else:
                exact = exact_scores(q[live], self.v[s], most)[i, j]
                self.products += may.size
            i, j = live[i], j + at
            good = exact >= bar[i]
            rows, ids, scores = np.append(rows, i[good]), np.append(ids, self.ids[j[good]]), np.append(scores, exact[good])
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
            place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
            keep = place < k
            last = place == k - 1
            bar[rows[last]] = scores[last]
            rows, ids, scores = rows[keep], ids[keep], scores[keep]
        return rows, ids, scores


def _visit(candidates: DataFrame, visits: DataFrame, rot: np.ndarray, h: int, dim: int, k: int, n_parts: int, copies: int) -> DataFrame:
    """candidates (block, id, v) and visits (block, id, v, least) -> (query_id, vec_id, score).

    A task holds one block and streams a share of its queries past it, so neither
    the number of queries nor that of candidates is bounded by memory, and the
    queries of a block meet it in ``copies`` tasks.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int")
    shared = candidates.select("block", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("part"), F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("least"))
    both = shared.unionByName(visits.select("block", part.alias("part"), F.lit(1).alias("kind"), "id", "v", "least"))

    def run(batches: Iterator[pa.RecordBatch]):
        block, now, held = None, None, []
        for b in batches:
            blocks, kinds = b.column(0).to_numpy().astype(np.int64) * copies + b.column(1).to_numpy(), b.column(2).to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip(np.append(0, edges).tolist(), np.append(edges, b.num_rows).tolist(), strict=True):
                if lo == hi:
                    continue
                rows_ = b.slice(lo, hi - lo)
                if blocks[lo] != now:
                    now, block, held = blocks[lo], None, []
                ids, v = rows_.column(3).to_numpy(), _matrix(rows_.column(4), dim)
                if kinds[lo] == 0:
                    held.append((ids, v))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), rot, h)
                for at in range(0, len(ids), 256):
                    s = slice(at, at + 256)
                    rows, found, scores = block.top(ids[s], v[s], rows_.column(5).to_numpy()[s], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s][rows]), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return both.repartition(n_parts, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(run, "query_id long, vec_id long, score long")


def _visits(queries: DataFrame, longest: np.ndarray) -> DataFrame:
    """queries (id, length, v, least) -> (block, id, v, least): the blocks after the first that can still hold a score of ``least``.

    ``longest`` has the greatest length of each block, descending: a number for each block reaches the driver.
    """

    def run(batches):
        for b in batches:
            length, least = b.column(1).to_numpy(), b.column(3).to_numpy().astype(float)
            need = np.where(length > 0, (least - 1e-6) / np.maximum(length, 1e-300) / (1 + 1e-9), -np.inf)
            need[(length == 0) & (least > 1e-6)] = np.inf
            n = np.searchsorted(-longest, -need, "right")  # blocks with longest >= need
            n = np.maximum(n - 1, 0)
            for lo in range(0, b.num_rows, 256):
                own = n[lo : lo + 256]
                row = np.repeat(np.arange(len(own)), own) + lo
                block = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + 1
                for at in range(0, len(row), 8192):
                    s = pa.array(row[at : at + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(block[at : at + 8192].astype(np.int32)), *(b.column(c).take(s) for c in (0, 2, 3))], names=["block", "id", "v", "least"])

    return queries.select("id", "length", "v", "least").mapInArrow(run, "block int, id long, v binary, least long")


def top_k(df: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``query_every``, candidates all
    rows with another id; equal scores go to the smaller id. Null ids and vectors
    that are null or hold null or non-finite components take no part; shorter
    vectors count as filled up with zeros. Rows that share an id: each is a
    candidate to others; as queries the repeated ids give one result over their
    distinct vectors' best. Fewer than k candidates: all of them. An empty table
    gives no rows. Extra columns are not read.
    """
    spark = df.sparkSession
    dim = df.agg(F.max(F.size(vector_col))).first()[0]
    out = "query_id long, rank int, vec_id long, score long"
    if not dim or dim < 0:
        return spark.createDataFrame([], out)
    scratch = Scratch(spark, "topk")
    vectors = scratch.table(scaled(df, id_col, vector_col, scale, dim))
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], out)
    rot, h = rotation(vectors, dim)
    n_blocks = max(-(-n // block_rows), min(partitions(spark), -(-n // 1024)))
    blocks = scratch.table(vectors.repartitionByRange(n_blocks, F.desc("length"), "id").withColumn("block", F.spark_partition_id()))
    scratch.drop(vectors)
    lengths = {r["block"]: r["longest"] for r in blocks.groupBy("block").agg(F.max("length").alias("longest")).collect()}
    #: a block without rows is passed with the length of the next
    longest = np.maximum.accumulate(np.asarray([lengths.get(i, 0.0) for i in range(n_blocks)])[::-1])[::-1]
    first = min(lengths)
    queries = blocks.where(F.col("id") % query_every == 0).select("id", "length", "v")
    n_queries = queries.count()
    copies = -(-n_queries // QUERIES)
    copies = max(1, copies, min(partitions(spark), n_queries // 512))
    lowest = F.lit(-(2**62)).cast("long")
    seen = scratch.table(_visit(blocks.where(F.col("block") == first), queries.select(F.lit(first).alias("block"), "id", "v", lowest.alias("least")), rot, h, dim, k, copies, copies))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bar = seen.dropDuplicates().withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    visits = _visits(queries.join(bar, "id", "left").withColumn("least", F.coalesce("least", lowest)), longest).where(F.col("block") > first)
    many = max(1, -(-n_queries // QUERIES))
    found = seen.unionByName(_visit(blocks.where(F.col("block") > first), visits, rot, h, dim, k, n_blocks * many, many)).dropDuplicates()
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
