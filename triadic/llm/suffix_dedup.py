"""Removal of repeated byte strings, by a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else. Texts are cut into units (see anchors), which fall into buckets by the hash
of their anchors' cores; only cores that occur twice can belong to repeats.
Units that are equal as a whole are repeats without more ado. What is left are
units whose core occurs elsewhere in other surroundings: the ends of repeated
passages, a few hundredths of the text. Their bytes are fetched and dealt out by
core. Each task keeps a family of suffix arrays: a batch of suffixes is sorted,
merge-scanned against every level for matches of ``length`` bytes, and levels of
equal size are merged, so that a suffix is moved a logarithmic number of times.

Occurrences are combined before they are shuffled: of a unit that a task holds
more than twice, and of a core with more than a few different units, a few go to
the bucket, which is enough to know that they repeat. The core's other units go
to the comparison at once, and a mark tells the bucket to send there one of each
unit that it sees of the core. Cores with very many
different units take another exact way, a count of their strings by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.anchors import MOST, units
from triadic.llm.bpe import small_batches
from triadic.llm.common import Scratch, partitions, ship
from triadic.llm.embedding_dedup import groups

_ENTRY = np.dtype([("core", "<u8"), ("unit", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("last", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
_FEW = 8  # units of a core that a task sends to the bucket
_REST = -1  # first of an entry that only says that a task sends more units of its core to be compared
REMOVE, COMPARE, ENTRY = 0, 1, 2
BUCKET_BYTES = 32 << 20  # of texts for each bucket; its entries take about two thirds of that


class SuffixFamily:
    """Sorted suffixes, compared by their first ``length`` bytes, in levels of geometric size.

    ``add`` takes suffixes and numbers them on; ``matched`` tells which of all
    so far have an equal. A level of class c holds fewer than 2^(c+1) x ``base``.
    """

    def __init__(self, length: int, base: int = 1 << 15):
        self.length, self.base = length, base
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n, self._matched, self.merges = 0, [], 0

    def add(self, buffer: np.ndarray, starts: np.ndarray) -> None:
        flat = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, self.length)[starts]).view(f"S{self.length}").ravel()
        order = np.argsort(flat, kind="stable")
        level, ids = flat[order], order + self.n
        self.n += len(starts)
        hit = np.zeros(len(starts), bool)
        same = level[1:] == level[:-1]
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        self._matched.append(hit)
        found = np.concatenate(self._matched)
        for other, names in self.levels.values():  # merge-scan
            at = np.searchsorted(other, level)
            ok = at < len(other)
            ok[ok] = other[at[ok]] == level[ok]
            found[ids[ok]] = True
            back = np.searchsorted(level, other)
            ok = back < len(level)
            ok[ok] = level[back[ok]] == other[ok]
            found[names[ok]] = True
        self._matched = [found]
        c = (len(level) // self.base).bit_length()
        while c in self.levels:  # equal sizes merge
            other, names = self.levels.pop(c)
            level, ids = np.concatenate([other, level]), np.concatenate([names, ids])
            order = np.argsort(level, kind="stable")  # two runs: a merge
            level, ids = level[order], ids[order]
            self.merges += 1
            c = max(c + 1, (len(level) // self.base).bit_length())
        self.levels[c] = (level, ids)

    @property
    def matched(self) -> np.ndarray:
        return self._matched[0] if self._matched else np.zeros(0, bool)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as maximal runs, touching ones joined."""
    out = np.empty(len(doc), _SPAN)
    out["doc"], out["start"], out["end"] = doc, start, end
    if not len(out):
        return out
    out = out[np.lexsort((out["start"], out["doc"]))]
    new = np.append(True, out["doc"][1:] != out["doc"][:-1])
    #: the furthest end so far in the document: ends rise by an offset for each document
    lift = np.cumsum(new).astype(np.int64) << 32
    reach = np.maximum.accumulate(out["end"] + lift)
    cut = np.append(True, out["start"][1:] + lift[1:] > reach[:-1])
    at = np.flatnonzero(cut)
    far = np.maximum.reduceat(out["end"], at)
    out = out[at]
    out["end"] = far
    return out


def _cut(raw: bytes, length: int) -> list[tuple[int, bytes]]:
    """A text in stretches that fit a buffer and hold each string of ``length`` bytes once."""
    if len(raw) <= MOST:
        return [(0, raw)]
    step = MOST - length + 1
    return [(i, raw[i : i + MOST]) for i in range(0, len(raw) - length + 1, step)]


def _map_units(length: int, core: int, n_buckets: int, chunk: int):
    """Texts -> rows (p, kind, data): spans to remove, units to compare, entries for the buckets."""

    def chunk_rows(e: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        e = e[np.lexsort((e["unit"], e["core"]))]
        new = np.append(True, (e["unit"][1:] != e["unit"][:-1]) | (e["core"][1:] != e["core"][:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(e)))
        place = np.arange(len(e)) - np.repeat(at, size)
        twice = np.repeat(size, size) > 1
        gone = e[twice & (place > 1)]
        if len(gone):
            yield int(gone["doc"][0] % n_buckets), REMOVE, merged(gone["doc"], gone["first"], gone["last"] + length).tobytes()
        e = e[place < 2]
        at = np.flatnonzero(np.append(True, e["core"][1:] != e["core"][:-1]))
        size = np.diff(np.append(at, len(e)))
        place = np.arange(len(e)) - np.repeat(at, size)
        rest = e[place >= _FEW]
        if len(rest):
            yield int(rest["core"][0] % np.uint64(n_buckets)), COMPARE, rest.tobytes()
        marks = np.zeros(int(np.sum(size > _FEW)), _ENTRY)
        marks["core"], marks["first"] = e["core"][at[size > _FEW]], _REST
        e = np.concatenate([e[place < _FEW], marks])
        p = (e["core"] % np.uint64(n_buckets)).astype(np.int64)
        e = e[np.argsort(p, kind="stable")]
        p.sort()
        cut = np.searchsorted(p, np.arange(n_buckets + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            yield i, ENTRY, e[cut[i] : cut[i + 1]].tobytes()

    def run(batches):
        held, n = [], 0
        for b in small_batches(batches, "text", MOST // 2):
            parts = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and len(raw := t.encode("utf-8", "surrogatepass")) >= length:
                    parts += [(k, at, x) for at, x in _cut(raw, length)]
            i = 0
            while i < len(parts):
                j, total = i, 0
                while j < len(parts) and (j == i or total + len(parts[j][2]) <= MOST):
                    total += len(parts[j][2])
                    j += 1
                end = np.cumsum([len(x) for _, _, x in parts[i:j]])
                begin = end - np.asarray([len(x) for _, _, x in parts[i:j]])
                d, _, first, last, c, u = units(np.frombuffer(b"".join(x for _, _, x in parts[i:j]), np.uint8), begin, end, length, core)
                e = np.empty(len(d), _ENTRY)
                shift = np.asarray([at for _, at, _ in parts[i:j]]) - begin
                e["core"], e["unit"], e["doc"] = c, u, np.asarray([k for k, _, _ in parts[i:j]], np.int64)[d]
                e["first"], e["last"] = first + shift[d], last + shift[d]
                held.append(e)
                n += len(e)
                i = j
            if n >= chunk:
                yield from _rows(chunk_rows(np.concatenate(held)))
                held, n = [], 0
        if n:
            yield from _rows(chunk_rows(np.concatenate(held)))

    return run


def _rows(rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["p", "kind", "data"])


def _bucket(length: int):
    """Rows of a bucket -> (kind, data): spans to remove, and a unit of each kind where a core has several."""

    def run(batches):
        for t in groups(batches, 1):
            kinds, data = t["kind"].to_numpy(), t["data"].to_pylist()
            out = [(k, x) for k, x in zip(kinds.tolist(), data, strict=True) if k != ENTRY]
            e = np.frombuffer(b"".join(x for k, x in zip(kinds.tolist(), data, strict=True) if k == ENTRY), _ENTRY)
            del data
            with_rest = np.unique(e["core"][e["first"] == _REST])
            e = e[e["first"] != _REST]
            if len(e):
                e = e[np.lexsort((e["unit"], e["core"]))]
                new_core = np.append(True, e["core"][1:] != e["core"][:-1])
                new_unit = new_core | np.append(True, e["unit"][1:] != e["unit"][:-1])
                at = np.flatnonzero(new_unit)
                copies = np.repeat(size := np.diff(np.append(at, len(e))), size)
                full = e[copies > 1]
                spans = merged(full["doc"], full["first"], full["last"] + length)
                out += [(REMOVE, spans[i : i + 50_000].tobytes()) for i in range(0, len(spans), 50_000)]
                core_at = np.flatnonzero(new_core[at])  # among units
                n_units = np.diff(np.append(core_at, len(at)))
                some_single = np.add.reduceat((size == 1).astype(np.int64), core_at) > 0
                rest = np.isin(e["core"][at[core_at]], with_rest)
                apart = e[at[np.repeat(((n_units > 1) & some_single) | rest, n_units)]]
                out += [(COMPARE, apart[i : i + 50_000].tobytes()) for i in range(0, len(apart), 50_000)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["kind", "data"])

    return run


def _spans(batches):
    for b in batches:
        s = np.frombuffer(b"".join(b.column(0).to_pylist()), _SPAN)
        yield pa.RecordBatch.from_arrays([pa.array(s[c]) for c in ("doc", "start", "end")], names=["k", "start", "end"])


def _unit_rows(batches):
    for b in batches:
        e = np.frombuffer(b"".join(b.column(0).to_pylist()), _ENTRY)
        yield pa.RecordBatch.from_arrays([pa.array(e["core"].view(np.int64)), *(pa.array(e[c]) for c in ("doc", "first", "last"))], names=["core", "k", "first", "last"])


def compare(fetched: DataFrame, length: int, n_parts: int) -> DataFrame:
    """(core, k, first, s) -> (k, start, end): strings of these stretches that another stretch has too."""

    def run(batches):
        family, owner, place = SuffixFamily(length), [], []
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, 512)
                at += 512
                stretches = part.column(3).to_pylist()
                size = np.asarray([len(x) for x in stretches])
                n = size - length + 1
                begin = np.cumsum(size) - size
                inst = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(inst)) - np.repeat(np.cumsum(n) - n, n)
                family.add(np.frombuffer(b"".join(stretches), np.uint8), begin[inst] + offset)
                owner.append(part.column(1).to_numpy()[inst])
                place.append(part.column(2).to_numpy()[inst] + offset)
        if family.n:
            hit = family.matched
            doc, start = np.concatenate(owner)[hit], np.concatenate(place)[hit]
            s = merged(doc, start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(s[c]) for c in ("doc", "start", "end")], names=["k", "start", "end"])

    return fetched.select("core", "k", "first", "s").repartition(n_parts, "core").mapInArrow(run, "k long, start int, end int")


def count_strings(fetched: DataFrame, length: int) -> DataFrame:
    """The same by a count of digests: for cores with more units than a task should hold."""

    def run(batches):
        for b in batches:
            for k, first, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = len(s) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s[i : i + length], digest_size=16).digest() for i in range(n)], pa.binary()), pa.array([k] * n, pa.int64()), pa.array(range(first, first + n), pa.int32())], names=["h", "k", "start"])

    w = fetched.select("core", "k", "first", "s").mapInArrow(run, "h binary, k long, start int").distinct()
    many = w.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return w.join(many, "h").select("k", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 200, core: int = 100, hot: int = 20_000, chunk: int = 400_000, most_broadcast: int = 500_000) -> DataFrame:
    """(k, start, end) of docs (k, text): stretches of bytes to remove, which may overlap."""
    spark = docs.sparkSession
    n = partitions(spark)
    #: a bucket is in memory as a whole: its number follows the input
    n = max(n, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    found = scratch.table(
        docs.select("k", "text").mapInArrow(_map_units(length, core, n, chunk), "p int, kind int, data binary")
        .repartition(n, "p").sortWithinPartitions("p").mapInArrow(_bucket(length), "kind int, data binary")
    )
    whole = found.where(F.col("kind") == REMOVE).select("data").mapInArrow(_spans, "k long, start int, end int")
    apart = scratch.table(found.where(F.col("kind") == COMPARE).select("data").mapInArrow(_unit_rows, "core long, k long, first int, last int").distinct())
    crowd = scratch.table(apart.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("core"))
    stretches, ids = apart.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0, apart.select("k").distinct()
    small = ids.limit(most_broadcast + 1).count() <= most_broadcast
    texts = docs.select("k", "text").join(F.broadcast(ids) if small else ids, "k", "left_semi").dropDuplicates(["k"])
    wanted = apart.groupBy("k").agg(F.collect_list(F.struct("core", "first", "last")).alias("u"))

    def fetch(batches):
        for b in small_batches(batches, "text"):
            out = {"core": [], "k": [], "first": [], "s": []}
            for k, t, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for u in us:
                    for c, v in zip(out, (u["core"], k, u["first"], raw[u["first"] : u["last"] + length]), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["core"], pa.int64()), pa.array(out["k"], pa.int64()), pa.array(out["first"], pa.int32()), pa.array(out["s"], pa.binary())], names=list(out))

    fetched = texts.join(wanted, "k").select("k", "text", "u").mapInArrow(fetch, "core long, k long, first int, s binary")
    n_parts = max(n, -(-stretches // 250_000))
    spans = whole
    if crowd.isEmpty():
        return spans.unionByName(compare(fetched, length, n_parts))
    fetched = scratch.table(fetched)
    spans = spans.unionByName(compare(fetched.join(crowd, "core", "left_anti"), length, n_parts))
    return spans.unionByName(count_strings(fetched.join(crowd, "core", "left_semi"), length))


def remove_repeats(docs: DataFrame, length: int = 200, core: int = 100, keep_text: bool = False, **how) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept (bytes).

    Each byte of the UTF-8 text goes that a string of ``length`` bytes covers which
    also starts elsewhere, in the same document or another; strings are those of
    the input, and none crosses documents. Null and empty texts, and texts
    shorter than ``length``, lose nothing. A row that is repeated is a copy, so
    its strings are repeats. Extra columns are not read.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark, "suffixes")
    #: one number for each document: its id where that is a number of its own; else a hash of id and text, which rows that repeat both share
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    own_id = whole and docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").isEmpty()
    rows = docs.select("doc_id", "text", (F.col("doc_id").cast("long") if own_id else F.xxhash64("doc_id", "text")).alias("k"))
    spans = scratch.table(repeated_spans(rows, scratch, length, core, **how))
    per_doc = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in small_batches(batches, "text"):
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                m = merged(np.zeros(len(s or ())), np.asarray([x["start"] for x in s or ()]), np.asarray([x["end"] for x in s or ()]))
                at, kept = 0, []
                for x in m:
                    kept.append(raw[at : x["start"]])
                    at = int(x["end"])
                left = b"".join([*kept, raw[at:]])
                for c, v in zip(out, (len(raw), len(raw) - len(left), len(m), hashlib.sha256(left).hexdigest(), left), strict=True):
                    out[c].append(v)
            cols = [pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept_sha256"], pa.string())] + [pa.array(out["kept"], pa.binary())] * keep_text
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *list(out)[: 4 + keep_text]])

    ddl = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return rows.join(per_doc, "k", "left").select("doc_id", "text", "s").mapInArrow(run, ddl)
