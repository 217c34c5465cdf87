"""Near duplicates among embeddings, by binary codes of randomly rotated vectors.

Each vector is scaled to length 1 and rotated at random; the signs are its code,
and the inner product of the vector with its own code is stored as a correction
factor. With a 4-bit copy of the other vector of a pair, code and factor give an
unbiased estimate of their inner product with a known spread. Signs of further
rotations deal the vectors into buckets, so that only vectors which share a
bucket in one of several tables are compared; the number of signs in a key
follows the logarithm of the number of vectors, and the number of tables the
recall asked for at the threshold.

In a bucket, a pair is set aside when the upper confidence bound of its estimate
stays below the threshold; what is left is computed exactly, in doubles, from the
stored vectors. A pair that meets in several tables counts in the first. Pairs
are counted inside the task that has the bucket and never written out: a bucket
gives a count for each vector and one link for each vector to the smallest of
its group. Large buckets are split into blocks, and blocks are compared in pairs
of blocks, each in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import Scratch, partitions, ship
from triadic.llm.components import components

BITS = 64


def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """n random rotations of vectors filled up to a multiple of BITS, of which each uses BITS coordinates."""
    wide = -(-dim // BITS) * BITS
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim] for _ in range(n)])


def layout(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits of a key, tables): about 32 unrelated vectors in a bucket, and a pair at the threshold missed with that probability."""
    bits = max(1, min(30, round(math.log2(max(n, 2) / 32))))
    same = 1 - math.acos(cosine) / math.pi
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same**bits)))


def units(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): vectors as doubles; those that are null, zero or hold null or non-finite components are left out."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            keep, rows = [], []
            for i, v in enumerate(b.column(1).to_pylist()):
                if v is None or any(x is None for x in v):
                    continue
                a = np.asarray(v, "<f8")
                if np.isfinite(a).all() and a.any():
                    keep.append(i)
                    rows.append((np.pad(a, (0, dim - len(a))) + 0.0).tobytes())  # + 0.0: no negative zero
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(rows, pa.binary())], names=["id", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), vector_col).where(F.col("id").isNotNull()).mapInArrow(run, "id long, v binary")


def unit(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    m = m / np.abs(m).max(1, keepdims=True)  # no overflow in the squares
    return m / np.sqrt((m * m).sum(1, keepdims=True))


class Coder:
    """Codes, correction factors, 4-bit copies and bucket keys. The first rotation is that of the estimate, the rest are those of the keys."""

    def __init__(self, dim: int, bits: int, tables: int, seed: int):
        self.dim, self.bits, self.tables = dim, bits, tables
        self.wide = -(-dim // BITS) * BITS
        self.rot = rotations(dim, 1 + -(-bits * tables // self.wide), seed)

    def code(self, o: np.ndarray):
        r = o @ self.rot[0]
        signs = r > 0
        factor = np.abs(r).sum(1) / math.sqrt(self.wide)
        top = np.abs(r).max(1)
        four = np.clip(np.floor((r / top[:, None] + 1) * 8), 0, 15).astype(np.uint8)
        return np.packbits(signs, axis=1), factor, top, four[:, ::2] << 4 | four[:, 1::2]

    def keys(self, o: np.ndarray) -> np.ndarray:
        signs = np.concatenate([o @ r > 0 for r in self.rot[1:]], 1)[:, : self.bits * self.tables]
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return signs.reshape(len(o), self.tables, self.bits).astype(np.int64) @ weights

    def read(self, code: np.ndarray, top: np.ndarray, four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (np.unpackbits(code, axis=1)[:, : self.wide].astype(np.float32) * 2 - 1) / math.sqrt(self.wide)
        q = np.empty((len(four), self.wide), np.float32)
        q[:, ::2], q[:, 1::2] = four >> 4, four & 15
        return x, ((q + 0.5) / 8 - 1) * top[:, None].astype(np.float32)

    def upper(self, x, q, factor, top, sure: float) -> np.ndarray:
        """Upper confidence bounds of all inner products of these vectors, from both sides' codes."""
        est = (q @ x.T) / factor[None, :]
        spread = (1 - factor**2) / factor**2 / (self.wide - 1)
        copy = (top / 8) ** 2 / 12  # of the 4-bit copies
        both = (est + est.T) / 2
        return both + sure * 0.5 * np.sqrt(spread[:, None] + spread[None, :] + copy[:, None] / factor[None, :] ** 2 + copy[None, :] / factor[:, None] ** 2)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of one key after the other, from batches sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for k in ks:
            change |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):  # noqa: B905
            own = tuple(k[lo] for k in ks)
            if own != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(entries: DataFrame, most: int, scratch: Scratch, most_broadcast: int = 100_000) -> DataFrame:
    """Splits the buckets (t, key) with more than ``most`` entries: each entry goes to the tasks of all pairs of blocks that hold its block.

    Large buckets are few and sent to the entries where they lie, so a bucket is split before it is anywhere together.
    """
    large = scratch.table(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most))
    large = F.broadcast(large) if large.limit(most_broadcast + 1).count() <= most_broadcast else large
    n = F.ceil(F.col("m") / F.lit(most)).cast("int")
    e = entries.join(large, ["t", "key"], "left").withColumn("own", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")))
    e = e.withColumn("other", F.explode(F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))))
    return e.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("m", "other")


def _dealt(e: DataFrame) -> DataFrame:
    return e.repartition(partitions(e.sparkSession), "t", "key", "b1", "b2").sortWithinPartitions("t", "key", "b1", "b2", "id")


def _first_table(keys: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    return ~(keys[i, :t] == keys[j, :t]).any(1)


def near_duplicates(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 0.005, sure: float = 4.0, block: int = 2048, seed: int = 7) -> DataFrame:
    """A row for each vector: id, n_links (other vectors with cosine >= ``cosine`` that were found), component_id, kept.

    component_id is the smallest id reachable by links, itself included; kept is
    whether it is the vector itself. No pair below the threshold is linked; a pair
    at the threshold is missed with probability ``miss`` (plus that of an estimate
    more than ``sure`` spreads off), closer pairs far less often. Equal vectors
    are compared once and count for all their copies. Vectors that are null, zero
    or hold null or non-finite components link with nothing; shorter vectors count
    as filled up with zeros. Rows with a null id are left out; rows that repeat an
    id give one row, in which their links add up. Extra columns are not read.
    """
    spark = df.sparkSession
    all_ids = df.select(F.col(id_col).cast("long").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    alone = all_ids.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    dim = df.agg(F.max(F.size(vector_col))).first()[0]
    if not dim or dim < 1:
        return alone
    scratch = Scratch(spark, "embeddings")
    vectors = scratch.table(units(df, id_col, vector_col, dim).withColumn("h", F.sha2("v", 256)))
    classes = scratch.table(vectors.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    n = classes.count()
    if not n:
        return alone
    coder = Coder(dim, *layout(n, cosine, miss), seed)

    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            o = unit(b.column(1).to_pylist())
            code, factor, top, four = coder.code(o)
            keys = coder.keys(o)
            packed = np.concatenate([code, four, np.stack([factor, top], 1).astype("<f4").view(np.uint8), keys.astype("<i4").view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["id", "code", "keys"])

    codes = classes.select("id", "v").mapInArrow(encode, "id long, code binary, keys array<long>")
    w = coder.wide
    sizes = np.cumsum([w // 8, w // 2, 8])
    #: with the keys of the tables before, in which a pair would have met already
    entries = codes.select("id", "code", F.posexplode("keys").alias("t", "key")).withColumn("code", F.substring("code", 1, F.lit(int(sizes[-1])) + 4 * F.col("t")))

    def unpack(column, t):
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, int(sizes[-1]) + 4 * t)
        code, four, f, keys = np.split(raw, sizes, 1)
        f = np.ascontiguousarray(f).view("<f4").astype(float)
        return code, four, f[:, 0], f[:, 1], np.ascontiguousarray(keys).view("<i4")

    def estimate(batches):
        """Which entries have a partner whose upper bound reaches the threshold."""
        for g in groups(batches, 4):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            t = int(g["t"][0].as_py())
            code, four, factor, top, keys = unpack(g["code"], t)
            x, q = coder.read(code, top, four)
            i, j = np.nonzero(np.triu(coder.upper(x, q, factor, top, sure) >= cosine, 1))
            if int(g["b1"][0].as_py()) != int(g["b2"][0].as_py()):
                own = g["own"].to_numpy()
                i, j = (m := own[i] != own[j], i[m], j[m])[1:]
            first = _first_table(keys, i, j, t)
            hit = np.unique(np.concatenate([i[first], j[first]]))
            if len(hit):
                yield from g.select(["t", "key", "id", "code"]).take(pa.array(hit)).to_batches()

    schema = "t int, key long, id long, code binary"
    cols = ["t", "key", "b1", "b2", "own", "id", "code"]
    hits = scratch.table(_dealt(in_blocks(entries, block, scratch).select(*cols)).mapInArrow(estimate, schema).dropDuplicates(["t", "key", "id"]))
    exact_in = hits.join(classes.select("id", "v", "copies"), "id")

    def exact(batches):
        """Links found, for each vector: how many, and one to the smallest of its group in the bucket."""
        for g in groups(batches, 4):
            if g.num_rows < 2:
                continue
            g = g.combine_chunks()
            t = int(g["t"][0].as_py())
            keys = unpack(g["code"], t)[-1]
            ids, copies, o = g["id"].to_numpy(), g["copies"].to_numpy(), unit(g["v"].to_pylist())
            own = g["own"].to_numpy()
            cross = int(g["b1"][0].as_py()) != int(g["b2"][0].as_py())
            i, j = np.nonzero(np.triu(o @ o.T >= cosine - 1e-9, 1))
            if cross:
                i, j = (m := own[i] != own[j], i[m], j[m])[1:]
            first = _first_table(keys, i, j, t)
            i, j = i[first], j[first]
            good = np.einsum("ij,ij->i", o[i], o[j]) >= cosine
            i, j = i[good], j[good]
            if not len(i):
                continue
            count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            root = np.arange(len(ids))
            while True:  # smallest index reachable
                low = root.copy()
                np.minimum.at(low, j, root[i])
                np.minimum.at(low, i, root[j])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(count[hit].astype(np.int64))], names=["a", "b", "n"])

    dealt = _dealt(in_blocks(exact_in, block, scratch).select(*cols, "v", "copies"))
    found = scratch.table(dealt.mapInArrow(exact, "a long, b long, n long"))
    scratch.drop(hits)
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comp = components(found, scratch).select(F.col("node").alias("id"), "component")
    per_class = classes.select("h", "id", "copies").join(counts, "id", "left").join(comp, "id", "left").select(
        "h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"),
    )
    per_id = vectors.select("id", "h").join(per_class, "h").groupBy("id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    return all_ids.join(per_id.withColumnRenamed("id", id_col), id_col, "left").select(
        id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", id_col).alias("component_id"),
        (F.coalesce("component", id_col) == F.col(id_col)).alias("kept"),
    )
