"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes hits a mask, so the cuts
depend on the content alone and copies, shared passages and edited documents
fall into the same chunks. Each chunk is encoded once in a worker and then read
from a bounded cache. A cut may fall inside a word, so tokens around a chunk join
are not those of the whole text: the join is repaired by encoding a stretch over
it again, by the library in one piece. The stretch takes in some words of both
chunks beyond what the join can change, and its tokens there must be the chunks'
own, on both sides. Where they are not, the text's stretches are made twice as
long, until they agree or the text is one stretch. The result equals that of the
whole text.

Inside a chunk, pieces between places where the vocabulary's rules end a token
(_SAFE) are looked up in a second bounded cache; agreement at joins checks these
rules too. Of what is new, plain words of a lower-case vocabulary with word ends
go through its own merges (see WordMerges), the rest through the tokenizers
library in one call for a batch of documents. A vocabulary with other rules, and
a text with a special string, are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import ship

#: A single space between these stands between two tokens in either vocabulary,
#: whatever is around: fixed rule of both pre-tokenizers.
_SAFE = re.compile(r"(?<=[A-Za-z0-9,.;:!?])(?= [A-Za-z0-9])")
_TWO_SPACES = re.compile(r"\s\s")
#: What Python alone takes as white space; what isn't lowered letter by letter in the same way by all.
_NOT_SPACE, _NOT_LATIN = re.compile("[\x1c-\x1f]"), re.compile("[^\x00-\u012f\u0131-\u024f]")
#: A word with the marks after it.
_WORD = re.compile(r" ?([^\W\d_]+)([.,;:!?*#$%&|]{0,4})")
_WINDOW = 16  # code units that the rolling hash sees
_MASK = 0x3FF  # a cut every 1024 characters on average
_LEAST, _MOST = 256, 8192
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def cuts(text: str) -> list[int]:
    """Chunk ends (code points), by a rolling hash over the last _WINDOW characters."""
    n = len(text)
    if n <= _LEAST:
        return [n]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _TABLE[codes & 0xFF] + codes.astype(np.uint64)
    total = np.cumsum(h * (np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
    roll = total.copy()
    roll[_WINDOW:] -= total[:-_WINDOW]  # the sum over the window, rolled on by one in, one out
    roll ^= h << np.uint64(17)  # a sum knows no order, so the last character counts once more
    roll *= np.uint64(0xFF51AFD7ED558CCD)
    hits = np.flatnonzero((roll >> np.uint64(40)) & np.uint64(_MASK) == 0) + 1
    out, last = [], 0
    for i in hits.tolist():
        while i - last > _MOST:
            last += _MOST
            out.append(last)
        if i - last >= _LEAST:
            out.append(i)
            last = i
    while n - last > _MOST:
        last += _MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def pieces(text: str) -> list[str]:
    """The text in pieces that are encoded each on its own. ``"".join`` gives the text back."""
    if not text:
        return []
    if _TWO_SPACES.search(text) or text[0].isspace() or text[-1].isspace():
        return _SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def words(text: str) -> list[str]:
    """Pieces for a vocabulary that drops white space and case: its runs of other characters."""
    if _NOT_SPACE.search(text):
        return _SAFE.split(text)
    return (text if _NOT_LATIN.search(text) else text.lower()).split()


class _Bounded(dict):
    """Two generations: a full one becomes the old one, and what is used again moves up."""

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.used, self.old = most_bytes, 0, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: unknown
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self[key] = value
        self.used += len(key) + 250 + (len(value) if isinstance(value, bytes) else 0)

    def has(self, key) -> bool:
        return key in self or key in self.old

    def turn(self) -> None:
        """Only between batches, so that a batch finds what it has put in."""
        if self.used > self.most:
            self.old = dict(self)
            self.clear()
            self.used = 0


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordMerges:
    """Merges of a vocabulary with word ends, for words of letters only, by rank.

    A word's last byte stands for that byte with the word end: an ASCII letter as
    its capital (texts are lower case), one of the 64 last bytes of other letters
    as a byte that no letter has. So the merges are those of plain byte strings,
    which tiktoken applies. Merging by the rank of the joined string gives the
    library's result if each token, merged by the list of merges, gives itself;
    tests check that for the vocabulary in use.
    """

    def __init__(self, model: dict):
        import tiktoken

        self.end = {x: x - 32 for x in range(97, 123)}
        free = [*range(32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
        self.end |= dict(zip(range(0x80, 0xC0), free, strict=True))
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {}
        for token, i in model["vocab"].items():
            raw = bytes(byte[c] for c in token.removesuffix("</w>"))
            key = self.mark(raw) if token.endswith("</w>") else raw
            if key is not None and (token.endswith("</w>") or not any(b in free or 65 <= b <= 90 for b in raw)):
                ranks.setdefault(key, i)
        for b in set(range(256)) - {k[0] for k in ranks if len(k) == 1}:
            ranks[bytes([b])] = 1_000_000 + b  # unused, but the library asks for all 256
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def mark(self, raw: bytes) -> bytes | None:
        last = self.end.get(raw[-1]) if raw else None
        return None if last is None else raw[:-1] + bytes([last])

    def word(self, w: str) -> bytes | None:
        """ids of a word of letters; None where this doesn't apply."""
        w = w.lower()
        if not w.isascii() and (not w.isalpha() or "\u03c3" in w or "\u03c2" in w or not unicodedata.is_normalized("NFC", w)):
            return None
        marked = self.mark(w.encode("utf-8", "surrogatepass"))
        if marked is None:
            return None
        ids = self.core.encode_single_piece(marked)
        return None if max(ids) >= 1_000_000 else struct.pack(f"<{len(ids)}I", *ids)


class ChunkEncoder:
    """ids of whole texts as the library gives them, as bytes (little-endian unsigned 32 bit)."""

    def __init__(self, path: str, cache_mb: int = 96, places: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        model, steps = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        lower = model.get("end_of_word_suffix") == "</w>" and r"'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in steps
        #: False: a vocabulary of another kind, whose splits aren't known here; its texts are encoded whole
        self.splits = lower or (spec.get("normalizer") is None and '"ByteLevel"' in steps and '"use_regex": true' in steps)
        self.merges = WordMerges(model) if lower else None
        self.cut = words if lower else pieces
        self.marks: dict[str, bytes] = {"": b""}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.piece = _Bounded(cache_mb * 500_000)
        self.chunk = _Bounded(cache_mb * 500_000)
        self.stats = {"texts": 0, "whole": 0, "chunks": 0, "chunks_new": 0, "joins": 0, "again": 0, "pieces_new": 0}
        self.places = places

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_merges(self, missing: list[str]) -> list[str]:
        """Puts in what WordMerges can do, and returns the rest."""
        rest, put, word = [], self.piece.put, self.merges.word
        for p in missing:
            m = _WORD.fullmatch(p)
            ids = word(m[1]) if m else None
            if ids is None:
                rest.append(p)
            elif m[2]:
                end = self.marks.get(m[2])
                if end is None:
                    end = self.marks[m[2]] = self._library([m[2]])[0]
                put(p, ids + end)
            else:
                put(p, ids)
        return rest

    def _steps(self, text: str, places: int) -> list:
        """("c", body) of chunks and ("j", stretch, own before, own after) of joins.

        A stretch goes from the ``places``-th last safe place of a chunk to the
        ``places``-th of the next. Own are the outer halves of the two sides. A
        chunk with fewer than twice as many goes with the next, the last with
        the one before; so a text may be a single chunk.
        """
        safe = [m.start() for m in _SAFE.finditer(text)]
        ends, first = [], 0  # (end, safe places before it) of chunks
        for end in cuts(text):
            last = bisect_left(safe, end, first)
            if last - first >= 2 * places:
                ends.append((end, last))
                first = last
        ends[-1:] = [(len(text), len(safe))]
        half, begin, out = places // 2, 0, []
        for _, n in ends[:-1]:
            i, own_i, own_j, j = safe[n - places], safe[n - places + half], safe[n + places - 1 - half], safe[n + places - 1]
            if i > begin:
                out.append(("c", text[begin:i]))
            out.append(("j", text[i:j], text[i:own_i], text[own_j:j]))
            begin = j
        if begin < len(text):
            out.append(("c", text[begin:]))
        return out

    def _pieces(self, lists: list[list[str]]) -> None:
        """Sees to it that all these pieces are known."""
        missing = [p for p in {p for ps in lists for p in ps} if not self.piece.has(p)]
        self.stats["pieces_new"] += len(missing)
        if self.merges:
            missing = self._by_merges(missing)
        for p, ids in zip(missing, self._library(missing), strict=True):
            self.piece.put(p, ids)

    def _try(self, texts: list[str], places: int) -> list[bytes | None]:
        """ids of each text; None where a join did not agree with the chunks on both sides."""
        st, plans, whole = self.stats, [], []
        fresh: dict[bytes, list[str]] = {}
        joins: dict[tuple[str, str, str], bytes | None] = {}
        for text in texts:
            steps = self._steps(text, places)
            special = not self.splits or any(a in text for a in self.added)  # special strings take precedence over all splitting
            if special or (places > self.places and len(steps) < 2):
                st["whole"] += 1
                plans.append(len(whole))
                whole.append(text)
                continue
            plan = []
            for step in steps:
                if step[0] == "c":
                    s = step[1]
                    key = hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    st["chunks"] += 1
                    if key not in fresh and not self.chunk.has(key):
                        st["chunks_new"] += 1
                        fresh[key] = self.cut(s)
                    plan.append(key)
                else:
                    st["joins"] += 1
                    joins[step[1:]] = None
                    plan.append(step[1:])
            plans.append(plan)
        own = {s: self.cut(s) for _, *sides in joins for s in sides}
        self._pieces([*fresh.values(), *own.values()])
        get = self.piece.__getitem__
        for key, ps in fresh.items():
            self.chunk.put(key, b"".join(map(get, ps)))
        for join, ids in zip(joins, self._library([j[0] for j in joins]), strict=True):
            before, after = (b"".join(map(get, own[s])) for s in join[1:])
            if len(ids) >= len(before) + len(after) and ids.startswith(before) and ids.endswith(after):
                joins[join] = ids
        done, of, out = self._library(whole), self.chunk.__getitem__, []
        for plan in plans:
            parts = [done[plan]] if isinstance(plan, int) else [of(x) if isinstance(x, bytes) else joins[x] for x in plan]
            out.append(None if None in parts else b"".join(parts))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text. Texts with a join that does not agree are tried again with stretches twice as long, at last as a whole."""
        self.piece.turn()
        self.chunk.turn()
        self.stats["texts"] += len(texts)
        out, places = self._try(texts, self.places), self.places
        while again := [i for i, x in enumerate(out) if x is None]:
            places *= 2
            self.stats["again"] += len(again)
            for i, ids in zip(again, self._try([texts[i] for i in again], places), strict=True):
                out[i] = ids
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tok.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, cache_mb: int = 96) -> ChunkEncoder:
    """One for each worker process, so that chunks are shared by all its tasks."""
    if (path, cache_mb) not in _ENCODERS:
        _ENCODERS[path, cache_mb] = ChunkEncoder(path, cache_mb)
    return _ENCODERS[path, cache_mb]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with a bounded amount of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most_bytes, "right")))
            yield b.slice(at, end - at)
            at = end


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cache_mb: int = 96, keep_ids: bool = True, keep_decoded: bool = False) -> DataFrame:
    """Adds to each row's id: ids (binary, little-endian unsigned 32 bit), n_tokens, decoded text and digests.

    One pass without a shuffle. Null and empty texts have no ids and decode to
    the empty text; rows with a repeated id are encoded each; other columns are
    not carried. ``keep_ids`` and ``keep_decoded`` say whether the large columns
    are returned beside ids_sha256 and decoded_sha256.
    """
    ship(docs.sparkSession)
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids + [("decoded", pa.string())] * keep_decoded
    ddl = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids + ", decoded string" * keep_decoded

    def run(batches):
        enc = encoder(tokenizer_path, cache_mb)
        for b in small_batches(batches, text_col):
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = enc.encode(texts)
            back = enc.decode(ids)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            cols = {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(x.encode()) for x in back], "ids": ids, "decoded": back}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[n], t) for n, t in fields)], names=[id_col, *(n for n, _ in fields)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)
