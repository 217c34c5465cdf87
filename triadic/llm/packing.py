"""Best-fit packing of token pieces into sequences, as vector bin packing.

Pieces have three sizes: tokens, documents (one each) and attention cost (the
square of the tokens). A bin has a capacity for each. A bin is filled by taking,
again and again, the piece that fits every residual capacity and has the highest
weighted dot product with the residuals (or the smallest residual norm).

All sizes follow from the number of tokens, so pieces of one length are
interchangeable: the packing is planned on the histogram of lengths, which has
at most ``max_tokens`` rows whatever the corpus. A filled bin is repeated while
the histogram has pieces for it, so there are at most as many patterns as
lengths, and the plan's size is bounded as well. Pieces then find their bin and
offset by their rank among those of their length.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triadic.llm.bpe import small_batches
from triadic.llm.common import Scratch, ship

_RANKS: dict = {}


def byte_ids(path: str):
    """Function from texts to ids of a byte-level vocabulary, as the tokenizers library gives them.

    The same merges are applied by rank, as tests check for the vocabulary in
    use; texts that hold a special string go through the tokenizers library, and
    so do all texts of a vocabulary of another kind.
    """
    if path in _RANKS:
        return _RANKS[path]
    import json

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    from triadic.llm.bpe import byte_letters

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["model"].get("end_of_word_suffix")
    if plain:
        import public_tokenizers

        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if plain and not any(a in text for a in added):
            return np.asarray(fast.encode_ordinary(text), "<u4")
        return np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4")

    return _RANKS.setdefault(path, ids)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens``: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are those of its text (null: empty), then ``end_id``. Only
    longer ones are cut; all their pieces but the first have ``max_tokens``.
    """
    ship(docs.sparkSession)

    def run(batches):
        encode = byte_ids(tokenizer_path)
        for b in small_batches(batches, "text"):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                first = (n - 1) % max_tokens + 1
                for k, end in enumerate(range(first, n + 1, max_tokens)):
                    start = 0 if k == 0 else end - max_tokens
                    raw = ids[start:end].tobytes()
                    for c, v in zip(out, (doc, k, start, end - start, zlib.crc32(raw), raw), strict=True):
                        out[c].append(v)
            cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32())] + [pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(out["ids"], pa.binary())] * keep_ids)], names=list(out)[: 5 + keep_ids])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def plan(counts: dict[int, int], capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "dot") -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first bin, offset): piece r of that length, from first rank
    on, goes to bin first bin + (r - first rank) at that offset.

    rule "dot": highest sum of weight x size x residual, all as shares of the
    capacity; "norm": smallest weighted norm of what would stay. Ties go to the
    longer piece, so that what is hard to place goes first.
    """
    cap = np.asarray(capacity, float)
    w = np.asarray(weights, float)
    lengths = np.asarray(sorted((n for n, c in counts.items() if c), reverse=True), np.int64)
    left = np.asarray([counts[n] for n in lengths.tolist()], np.int64)
    sizes = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / cap
    if len(sizes) and (sizes > 1 + 1e-12).any():
        raise ValueError(f"a piece of {lengths[(sizes > 1 + 1e-12).any(1)][0]} tokens fits no bin")
    used = np.zeros(len(lengths), np.int64)
    rows, bins = [], 0
    live = np.arange(len(lengths))
    while len(live := live[left[live] > 0]):
        residual, took, order = np.ones(3), np.zeros(len(lengths), np.int64), []
        while True:
            fits = live[(sizes[live] <= residual + 1e-12).all(1) & (took[live] < left[live])]
            if not len(fits):
                break
            if rule == "dot":
                best = fits[np.argmax(sizes[fits] @ (w * residual))]
            else:
                best = fits[np.argmin(((residual - sizes[fits]) ** 2) @ w)]
            residual = residual - sizes[best]
            took[best] += 1
            order.append(int(best))
        times = int((left[took > 0] // took[took > 0]).min())
        offset = 0
        for i in order:
            rows.append((int(lengths[i]), int(used[i]), times, bins, offset))
            used[i] += times
            offset += int(lengths[i])
        left -= took * times
        bins += times
    return rows


def assign(pieces: DataFrame, max_tokens: int, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "dot") -> DataFrame:
    """Adds sequence_id and offset to pieces (a table that gives the same rows when read again).

    Ranks among the pieces of a length are counted per (length, bucket of the
    document id), then shifted by the buckets before: no length, however common,
    meets in one task, and a task that runs again deals the same ranks.
    """
    spark = pieces.sparkSession
    n_buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)))
    counts = p.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    rows = plan(histogram, (max_tokens, max_docs or max_tokens, max_attention or max_tokens**2), weights, rule)
    schema = "length long, first_rank long, n long, first_bin long, offset long"
    table = spark.createDataFrame(rows, schema)
    #: the rank ranges of a length, as one sorted array: at most max_tokens rows, with at most max_tokens patterns in all
    ranges = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "first_bin", "offset"))).alias("_ranges"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = p.join(base, ["length", "_bucket"]).withColumn("_rank", F.row_number().over(order) - 1 + F.col("base"))
    placed = ranked.join(F.broadcast(ranges), "length")
    i = F.size(F.filter("_ranges", lambda r: r["first_rank"] <= F.col("_rank")))
    at = F.element_at("_ranges", i)
    return placed.select(
        *[c for c in pieces.columns],
        (at["first_bin"] + F.col("_rank") - at["first_rank"]).alias("sequence_id"), at["offset"].alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, end_id: int = 2, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.25), rule: str = "dot", keep_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of at most ``max_tokens``.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids, if kept). Sequence numbers are 0 to n - 1, offsets gapless.
    ``max_docs`` bounds the documents in a sequence and ``max_attention`` the sum
    of squared lengths; without them they don't bind. Null and empty texts are
    pieces of one token. A table without rows gives none. Rows with a repeated
    id are packed each. Other columns are not carried.
    """
    limit = min(max_tokens, int((max_attention or max_tokens**2) ** 0.5))
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer_path, limit, end_id, keep_ids))
    return assign(pieces, max_tokens, max_docs, max_attention, weights, rule)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces (with ids) as rows sequence_id, ids, lengths: what a trainer reads."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"),
    )
