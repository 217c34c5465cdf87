"""N-gram Jaccard join by partitions of the universe and the pigeonhole principle.

A document is the set of its word shingles. Two sets within the threshold differ
in at most H elements, H from their sizes. Sizes fall into bands; for each band
the universe of shingles is dealt into segments by a hash, and what a set holds
of a segment is its subset there. With more than H segments, two such sets have
the same subset in at least one. Subsets of no or one shingle would collide with
everything, so there are some more segments than H + 1, and light subsets are
left out wherever a set still has more than H heavier ones. A set that has not
goes by one-deletion neighbourhoods: about half as many segments, in which the
subset and the subset without each one of its shingles are keys, so that any
segment with at most one difference is found, and each counts twice against H.
The allocation that is expected to need fewer rows is chosen for each band. A
pair meets if either set can rely on its heavier subsets, or else in the second
layout, so nothing is lost; what meets is verified on the texts.

A set is keyed in its own band and, if it may have partners there, in the next.

Keys that two sets share give candidate groups. A group need not be compared
pair by pair: each member is verified against the smallest of its groups first.
Then
members of groups which still lie in several components are verified against
their neighbours in some orders of the group, which joins most of what
belongs together by a number of pairs in proportion to the members. Of groups
that are still apart, only pairs across components count whose bitmaps allow a link: the parities of
two sets' elements in the cells of a hash differ in at most as many cells as the
sets differ in elements, so a pair that is set aside can't be linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triadic.llm.bpe import small_batches
from triadic.llm.common import Scratch, partitions, ship
from triadic.llm.components import components
from triadic.llm.embedding_dedup import groups
from triadic.llm.textnum import Words, mix

RATIO = 1.6  # of the sizes in a band
SPARE = 0.2  # more segments than H + 1, as a share
WORDS = 16  # of 64 bits in a bitmap
LIGHT = 1  # subsets of so many shingles are left out where they can be


class Layout:
    """Bands, segments and allocations for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [0]  # band k holds sizes edges[k] + 1 to edges[k + 1]
        while self.edges[-1] < 2**40:
            self.edges.append(max(self.edges[-1] + 1, int(max(4, self.edges[-1]) * RATIO), self.edges[-1] * 100 // percent))
        self.bounds = np.asarray(self.edges[1:])
        hi = self.bounds.astype(float)
        h = self.differ(hi, hi)
        self.exact = np.maximum(1, np.ceil((h + 1) * (1 + SPARE))).astype(np.int64) + 1
        self.near = np.maximum(1, np.ceil((h + 1) / 2 * (1 + SPARE / 2))).astype(np.int64)
        self.by_exact = np.asarray([self._rows(int(n), int(m), int(s), int(d)) for n, m, s, d in zip(self.bounds, self.exact, self.near, h, strict=True)])

    def differ(self, a, b):
        """Most elements in which linked sets of up to these sizes differ."""
        return np.floor((a + b) * (100 - self.percent) / (100 + self.percent) + 1e-9).astype(np.int64)

    def _rows(self, n: int, m: int, near: int, h: int) -> bool:
        """Whether exact subsets are expected to need fewer rows: they cost m, and the other layout for sets that can't rely on them."""
        lam = n / m
        light = math.exp(-lam) * (1 + lam)
        spread = math.sqrt(max(m * light * (1 - light), 1e-9))
        z = (m * (1 - light) - (h + 1)) / spread
        over = 0.5 * math.erfc(z / math.sqrt(2))
        return m + over * (n + near) < n + near

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n)

    def keys(self, doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, doc) of all sets, given as rows (doc, shingle) sorted by doc."""
        size = np.bincount(doc, minlength=n_docs)
        begin = np.cumsum(size) - size
        live = np.flatnonzero(size)
        own = self.band(size[live])
        #: partners of the next band have at most 100 / percent of the size
        nxt = size[live] * 100 // self.percent > self.bounds[own]
        inst_doc, inst_band = np.concatenate([live, live[nxt]]), np.concatenate([own, own[nxt] + 1])
        n = size[inst_doc]
        hi = self.bounds[inst_band]
        limit = self.differ(n, np.maximum(n, np.minimum(hi, n * 100 // self.percent)))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        first = self.by_exact[inst_band]
        weak = ~first
        if first.any():
            heavy = self._exact(inst_doc[first], inst_band[first], begin, size, h, out)
            weak[np.flatnonzero(first)] = heavy < limit[first] + 1
        if weak.any():
            self._near(inst_doc[weak], inst_band[weak], limit[weak], begin, size, h, out)
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate([k for k, _ in out]), np.concatenate([d for _, d in out])

    @staticmethod
    def _rows_of(docs: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(instance, row) of all shingles of these sets."""
        n = size[docs]
        inst = np.repeat(np.arange(len(docs)), n)
        return inst, np.arange(len(inst)) - np.repeat(np.cumsum(n) - n, n) + begin[docs][inst]

    @staticmethod
    def _salt(band: np.ndarray, kind: int) -> np.ndarray:
        return mix(band.astype(np.uint64) * np.uint64(4) + np.uint64(kind + 1))

    def _segments(self, docs, band, m, kind, begin, size, h):
        inst, row = self._rows_of(docs, begin, size)
        x = h[row]
        seg = (mix(x ^ self._salt(band, kind)[inst]) % m[inst].astype(np.uint64)).astype(np.int64)
        at = np.cumsum(m) - m
        flat = at[inst] + seg
        count = np.bincount(flat, minlength=int(m.sum()))
        total = np.zeros(len(count), np.uint64)
        np.add.at(total, flat, mix(x))
        inst_of = np.repeat(np.arange(len(docs)), m)
        place = np.arange(len(count)) - at[inst_of]
        name = mix(self._salt(band, kind)[inst_of] + place.astype(np.uint64))
        return inst, x, flat, count, total, inst_of, name

    def _exact(self, docs, band, begin, size, h, out) -> np.ndarray:
        """Adds heavy subsets; returns how many each set has."""
        _, _, _, count, total, inst_of, name = self._segments(docs, band, self.exact[band], 0, begin, size, h)
        ok = count > LIGHT
        out.append((mix(total[ok] ^ name[ok]), docs[inst_of[ok]]))
        return np.bincount(inst_of[ok], minlength=len(docs))

    def _near(self, docs, band, limit, begin, size, h, out) -> None:
        """Adds subsets and one-deletion neighbourhoods; light keys only of sets that can't do without."""
        inst, x, flat, count, total, inst_of, name = self._segments(docs, band, self.near[band], 1, begin, size, h)
        strong = np.bincount(inst_of, 2 * (count - 1 > LIGHT), len(docs)) >= limit + 1
        ok = (count > LIGHT) | ~strong[inst_of]
        out.append((mix(total[ok] ^ name[ok]), docs[inst_of[ok]]))
        ok = (count[flat] - 1 > LIGHT) | ~strong[inst]
        out.append((mix((total[flat[ok]] - mix(x[ok])) ^ name[flat[ok]]), docs[inst[ok]]))


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h): size and digest of each document's set; h is null for the empty set."""

    def run(batches):
        for b in small_batches(batches, "text"):
            w = Words([t or "" for t in b.column(1).to_pylist()])
            doc, h = w.shingles(n)
            size = np.bincount(doc, minlength=b.num_rows)
            end = np.cumsum(size)
            raw = [hashlib.blake2b(h[e - s : e].tobytes(), digest_size=16).digest() if s else None for s, e in zip(size.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "n_shingles", "h"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h binary")


def _entries(docs: DataFrame, n: int, layout: Layout, n_buckets: int) -> DataFrame:
    """Keys of all sets, packed by bucket: (p, keys, docs). Copies of a set in one task are keyed once."""

    def run(batches):
        seen: set[bytes] = set()
        for b in small_batches(batches, "text"):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            doc, h = Words([t or "" for t in b.column(1).to_pylist()]).shingles(n)
            size = np.bincount(doc, minlength=b.num_rows)
            end = np.cumsum(size)
            new = np.zeros(b.num_rows, bool)
            for i in np.flatnonzero(size):
                digest = hashlib.blake2b(h[end[i] - size[i] : end[i]].tobytes(), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    new[i] = True
            ok = new[doc]
            keys, d = layout.keys(doc[ok], h[ok], b.num_rows)
            p = (keys % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(p, kind="stable")
            keys, d, p = keys[order], ids[d[order]].astype("<i8"), p[order]
            cut = np.searchsorted(p, np.arange(n_buckets + 1))
            full = [i for i in range(n_buckets) if cut[i + 1] > cut[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()), pa.array([d[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())],
                names=["p", "keys", "docs"],
            )

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return known.mapInArrow(run, "p int, keys binary, docs binary")


def candidate_groups(entries: DataFrame) -> DataFrame:
    """(g, doc): documents that share a key, once for each set of documents that do."""

    def run(batches):
        for t in groups(batches, 1):
            keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint64)
            docs = np.frombuffer(b"".join(t["docs"].to_pylist()), "<i8")
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
            keys, docs = keys[new], docs[new]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(at, len(keys)))
            name = np.add.reduceat(mix(docs.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), at)
            many = np.flatnonzero(size > 1)
            _, once = np.unique(name[many], return_index=True)
            pick = np.zeros(len(at), bool)
            pick[many[once]] = True
            row = np.repeat(pick, size)
            g, d = np.repeat(name.view(np.int64), size)[row], docs[row]
            for lo in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[lo : lo + 100_000]), pa.array(d[lo : lo + 100_000])], names=["g", "doc"])

    n = partitions(entries.sparkSession)
    return entries.repartition(n, "p").sortWithinPartitions("p").mapInArrow(run, "g long, doc long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch, most_broadcast: int = 500_000) -> DataFrame:
    """(a, b, linked): whether the exact Jaccard similarity of the texts of a pair reaches the threshold.

    The texts that pairs need are stored once; both joins are then between two
    shuffles, so that adaptive joins split the pairs of a much compared document.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = ids.limit(most_broadcast + 1).count() <= most_broadcast
    own = scratch.table(texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))
    of = lambda c: own.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))

    def run(batches):
        for b in batches:
            size = np.cumsum([0, *(len(x or "") + len(y or "") for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))])
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(size, size[at] + (2 << 20), "right")) - 1)
                part = b.slice(at, end - at)
                at = end
                a, own_a = part.column(0).to_numpy(), {}
                ta = part.column(2).to_pylist()
                for i, x in enumerate(a.tolist()):
                    own_a.setdefault(x, i)
                first = list(own_a.values())
                texts = [ta[i] or "" for i in first] + [t or "" for t in part.column(3).to_pylist()]
                doc, h = Words(texts).shingles(n)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                place = {x: k for k, x in enumerate(own_a)}
                linked = []
                for k, x in enumerate(a.tolist()):
                    i, j = place[x], len(first) + k
                    u, v = h[cut[i] : cut[i + 1]], h[cut[j] : cut[j + 1]]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    union = len(u) + len(v) - both
                    linked.append(bool(union) and 100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def bitmaps(docs: DataFrame, ids: DataFrame, n: int, most_broadcast: int = 500_000) -> DataFrame:
    """(doc, n, w0 to w15): set size, and the parity of the shingles in each of 1024 cells, of the documents in ids (doc)."""
    small = ids.limit(most_broadcast + 1).count() <= most_broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(ids) if small else ids, "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text"))

    def run(batches):
        for b in small_batches(batches, "text"):
            doc, h = Words([t or "" for t in b.column(1).to_pylist()]).shingles(n)
            cell = doc * 1024 + (mix(h) >> np.uint64(54)).astype(np.int64)
            odd = (np.bincount(cell, minlength=1024 * b.num_rows) & 1).astype(np.uint8).reshape(b.num_rows, 1024)
            w = np.packbits(odd, axis=1).view("<i8")
            size = np.bincount(doc, minlength=b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *(pa.array(np.ascontiguousarray(w[:, i])) for i in range(WORDS))], names=["doc", "n", *(f"w{i}" for i in range(WORDS))])

    return texts.mapInArrow(run, "doc long, n long, " + ", ".join(f"w{i} long" for i in range(WORDS)))


CHUNK = 10_000  # members of a group that are put in a random order together
BLOCK = 1_000  # members of a group whose pairs with as many others are one piece of work


def link_groups(members: DataFrame, verify, scratch: Scratch, percent: int, sketch=None, words: int = 0, closer=None, may=None) -> DataFrame:
    """(node, component) of the links inside candidate groups (g, doc), without comparing all pairs of a group.

    verify(pairs (a, b), a < b) -> (a, b, linked). Groups of two are pairs and
    settled at once; members of larger ones are compared with the smallest. What
    then lies in several components goes on in one of two ways, and in both every
    two linked members of a group end in one component. With ``words``,
    sketch(ids (doc)) -> (doc, n, w0 to w<words - 1>), set size and bitmap, rules
    pairs out exactly. With ``closer``, closer(members) -> (doc, f) are keys of
    which similar members share several: those that share one are compared with
    some members that have it. Of groups that are still in several components all
    pairs across components are then compared, but for those that may("a", "b"),
    a condition on the columns of sketch(ids (doc)) as a_<column> and b_<column>,
    leaves out, which verify must not link. verify may leave out pairs that aren't linked.
    """
    m = members if hasattr(members, "_scratch_path") else scratch.table(members)
    rows = m.count()  # no table of members or groups has more
    group = scratch.table(m.groupBy("g").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count(F.lit(1)).alias("c")), rows=rows)
    large = group.where("c > 2")
    star = m.join(large.select("g", "a"), "g").where("doc <> a").select("a", F.col("doc").alias("b"))
    if closer is None:
        star = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    two = group.where("c = 2").select("a", F.col("z").alias("b"))
    known = scratch.table(verify(scratch.table(star.unionByName(two).distinct())))
    scratch.release()
    comp = scratch.table(components(known.where("linked"), scratch))

    def still_open(t: DataFrame, comp: DataFrame) -> DataFrame:
        """Groups that lie in several components, with those; of groups of the same members one."""
        t = t.join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        t = scratch.table(t, rows=rows)
        name = [F.sum(F.pmod(F.xxhash64("doc", F.lit(i)), F.lit(2**31))).alias(f"name{i}") for i in range(2)]
        lo_hi = t.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"), F.min("doc").alias("x"), F.max("doc").alias("y"), *name)
        open_groups = scratch.table(lo_hi.where("lo <> hi").groupBy("c", "x", "y", "name0", "name1").agg(F.min("g").alias("g")).select("g", "c"), rows=rows)
        out = scratch.table(t.join(open_groups, "g"), rows=rows)
        scratch.drop(t, open_groups)
        return out

    def beside(t: DataFrame) -> DataFrame:
        """Pairs of neighbours in random orders of a group, if in different components.

        A group is put in order in chunks of CHUNK members at random, so it is nowhere together.
        """
        out = None
        for i in range(3):
            chunk = F.pmod(F.xxhash64("doc", F.lit(-i - 1)), F.floor(F.col("c") / CHUNK) + 1)
            w = Window.partitionBy("g", "chunk").orderBy(F.xxhash64("doc", F.lit(i)))
            p = t.withColumn("chunk", chunk).select("doc", "component", F.lag("doc").over(w).alias("x"), F.lag("component").over(w).alias("cx")).where("component <> cx")
            p = p.select(F.least("doc", "x").alias("a"), F.greatest("doc", "x").alias("b"))
            out = p if out is None else out.unionByName(p)
        return out

    def close(t: DataFrame, seeds: list[int]) -> DataFrame:
        """Pairs of members in different components with the first of those that share a group and a closer key, by as many random orders."""
        keyed = scratch.table(t.select("g", "doc", "component").join(closer(t), "doc").select(F.xxhash64("g", "f").alias("gf"), "doc", "component"))
        passing.append(keyed)
        firsts = [F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("order"), F.col("doc").alias("x"), F.col("component").alias("cx"))) for i in seeds]
        least = keyed.groupBy("gf").agg(F.array(*firsts).alias("first"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gf", F.explode("first").alias("p"))
        least = scratch.table(least.select("gf", "p.x", "p.cx").distinct())
        passing.append(least)
        p = keyed.join(least, "gf").where("component <> cx")
        return p.select(F.least("doc", "x").alias("a"), F.greatest("doc", "x").alias("b"))

    def across(t: DataFrame) -> DataFrame:
        """All pairs of members of a group in different components that may be linked.

        Members are dealt into blocks, and every two blocks meet by themselves, so no group is one piece of work.
        """
        blocks = F.floor(F.col("c") / BLOCK).cast("int") + 1
        size = t.groupBy("g").agg(F.count(F.lit(1)).alias("c")).select("g", blocks.alias("blocks"))
        ids = scratch.table(t.select("doc").distinct(), rows=rows)
        t = t.select("g", "doc", "component").join(size, "g").join(sketch(ids), "doc")
        t = scratch.table(t.withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int")), rows=rows)
        passing.extend((ids, t))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        side = lambda k: t.select("g", *(F.col(c).alias(f"{k}_{c}") for c in t.columns if c not in ("g", "own", "blocks")), F.col("own").alias("i" if k == "a" else "j"), every.alias("j" if k == "a" else "i"))
        met = side("a").join(side("b"), ["g", "i", "j"]).where((F.col("a_doc") < F.col("b_doc")) & (F.col("a_component") != F.col("b_component")) & may("a", "b"))
        return met.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))

    passing: list[DataFrame] = []  # tables that only the next pairs come from

    def learn(pairs: DataFrame) -> None:
        nonlocal known, comp
        pairs = scratch.table(pairs.distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"))
        scratch.drop(*passing)
        passing.clear()
        old = known, comp
        known = scratch.table(known.unionByName(verify(pairs)))
        scratch.release()
        comp = scratch.table(components(known.where("linked"), scratch))
        scratch.drop(*old)

    left = still_open(m.join(large.select("g"), "g", "left_semi"), comp)
    if closer is not None:
        for more in (lambda t: close(t, [1, 2, 3]), across):
            if not left.isEmpty():
                old = left
                learn(more(left))
                if more is not across:
                    left = still_open(left.select("g", "doc"), comp)
                scratch.drop(old)
        return comp
    if left.isEmpty():
        return comp
    learn(beside(left))
    left = still_open(left.select("g", "doc"), comp)
    if left.isEmpty():
        return comp
    maps = scratch.table(sketch(scratch.table(left.select("doc").distinct())))
    share = (100 - percent) / (100 + percent)
    #: similar sets are of one class of sizes or of neighbouring ones: a member is itself in its class, and meets those of its own and the next
    size_class = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
    with_maps = scratch.table(left.select("g", "doc", "component").join(maps, "doc").withColumn("class", size_class))
    of = lambda k: with_maps.select("g", F.col("doc").alias(k), F.col("component").alias(f"c{k}"), F.col("class").alias(f"s{k}"), F.col("n").alias(f"n{k}"), *(F.col(f"w{i}").alias(f"{k}{i}") for i in range(words)))
    x = of("a").withColumn("class", F.col("sa"))
    y = of("b").withColumn("class", F.explode(F.array("sb", F.col("sb") - 1)))
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(words)), F.lit(0))
    once = (F.col("sa") != F.col("sb")) | (F.col("a") < F.col("b"))
    may = once & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ <= (F.col("na") + F.col("nb")) * share + 1e-6)
    pairs = x.join(y, ["g", "class"]).where(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    learn(pairs)
    return comp


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5, bucket_entries: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    n_shingles is the size of the document's set of distinct ``n``-word shingles
    (A-Z lowered, words between ASCII white space; with fewer words, all of them
    as one). Documents are linked where 100 x intersection >= ``percent`` x
    union; component_id is the smallest doc_id reachable by links, itself
    included. Null texts and texts without words have the empty set and are
    linked with nothing. Equal sets are verified once, as one. Rows with a null
    doc_id have a null component. Rows that repeat a doc_id count as one document
    (of different texts, the greatest stands for it in comparisons). An empty
    table gives no rows. Extra columns are not read.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "ngrams")
    sets = scratch.table(shingle_sets(docs, n))
    classes = scratch.table(sets.where("h is not null and doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("class")))
    member = scratch.table(sets.join(classes, "h", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class")))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(partitions(spark), -(-total // (2 * bucket_entries)))
    found = candidate_groups(_entries(docs, n, Layout(percent), n_buckets))
    same = member.groupBy(F.col("doc_id").alias("doc")).agg(F.min("class").alias("class"))
    members = found.join(same, "doc").select("g", F.col("class").alias("doc")).distinct()
    comp = link_groups(members, lambda pairs: verified(pairs, docs, n, percent, scratch), scratch, percent, lambda ids: bitmaps(docs, ids, n), WORDS)
    by_class = comp.select(F.col("node").alias("class"), "component")
    return member.join(by_class, "class", "left").select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id"))
