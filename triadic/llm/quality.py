"""Quality classifier: regularised quadratic discriminant analysis on statistics of documents.

Shares of characters, words and lines are smoothed towards typical values by
pseudo-counts, so that short texts don't look odd, and brought near a normal
shape. Each class gets a mean and a covariance, shrunk towards that of both
classes and towards a multiple of the identity. The score is the probability of
class 1 from the difference of the log densities: Mahalanobis distances by
Cholesky factors that are computed once, on the driver, and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.bpe import small_batches
from triadic.llm.common import Scratch, ship
from triadic.llm.textnum import SPACE, Words

FEATURES = ("chars", "word_length", "upper", "digit", "marks", "symbols", "strokes", "cries", "wide", "distinct", "again", "top", "lines", "short", "caps_words", "marked_words")
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3
for _k, _chars in ((4, b".,;:'\"-()?"), (5, b"#$%&*@^~+=<>[]{}\\_`"), (6, b"|/"), (7, b"!")):
    _CLASS[list(_chars)] = _k
#: (typical share, pseudo-counts) of a smoothed share
_TYPICAL = {"upper": (0.03, 100), "digit": (0.005, 100), "wide": (0.03, 100), "marks": (0.03, 100), "symbols": (0.002, 100), "strokes": (0.002, 100), "cries": (0.002, 100), "again": (0.01, 20), "top": (0.05, 20), "lines": (0.0, 2), "short": (0.35, 20), "caps_words": (0.02, 20), "marked_words": (0.01, 20)}


def statistics(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has the typical values."""
    n = len(texts)
    w = Words(texts, lower=False)
    kind = _CLASS[w.raw]
    begin = np.append(0, w.ends[:-1] + 1)

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values, dtype=np.float64))
        return total[at[1]] - total[at[0]]

    spans, words = (begin, w.ends), (w.first[:-1], w.first[1:])
    chars = (w.ends - begin).astype(float)
    count = np.diff(w.first).astype(float)
    letters = {k: per_doc(kind == i, spans) for i, k in ((1, "upper"), (2, "digit"), (3, "wide"), (4, "marks"), (5, "symbols"), (6, "strokes"), (7, "cries"))}
    filled = chars - per_doc(SPACE[w.raw], spans)
    # words: the same as the one before, distinct, most frequent, short, all capitals, with a symbol
    size = w.end - w.start
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])) if len(w.hash) else np.empty(0, bool)
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    distinct = np.bincount(d[at], minlength=n).astype(float) if len(at) else np.zeros(n)
    top = np.zeros(n)
    if len(at):
        np.maximum.at(top, d[at], run)
    in_word = lambda k: np.diff(np.append(0, np.cumsum(np.isin(kind, k), dtype=np.int64))[np.stack([w.start, w.end])], axis=0)[0]
    caps, odd = in_word([1]), in_word([5, 6, 7])
    # lines that are repeated in their text
    lines, repeated = np.zeros(n), np.zeros(n)
    for i, x in enumerate(texts):
        if "\n" in x:
            own = [y for y in x.split("\n") if y]
            lines[i], repeated[i] = len(own), len(own) - len(set(own))
    share = {k: (v, filled) for k, v in letters.items()}
    share |= {"again": (per_doc(same, words), count), "top": (np.maximum(top - 2, 0), count), "lines": (repeated, lines), "short": (per_doc(size <= 3, words), count)}
    share |= {"caps_words": (per_doc((caps >= 2) & (caps * 2 > size), words), count), "marked_words": (per_doc(odd > 0, words), count)}
    out = {k: np.arcsin(np.sqrt(np.clip((v + _TYPICAL[k][0] * _TYPICAL[k][1]) / (m + _TYPICAL[k][1]), 0, 1))) for k, (v, m) in share.items()}
    out["chars"] = 0.2 * np.log1p(chars)
    out["word_length"] = np.log((filled + 5.5 * 20) / (count + 20))
    out["distinct"] = np.log(distinct + 20) / np.log(count + 20)
    return np.stack([out[k] for k in FEATURES], 1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): one pass over the texts, without a shuffle. Null text: empty."""
    ship(docs.sparkSession)

    def run(batches):
        for b in small_batches(batches, "text"):
            x = statistics([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def moments(rows: DataFrame, dim: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """class -> (count, sums, sums of products) of rows (label, x): (dim + 1)^2 numbers a class reach the driver."""

    def run(batches):
        total = {0: np.zeros((dim + 1, dim + 1)), 1: np.zeros((dim + 1, dim + 1))}
        for b in batches:
            x = np.asarray(b.column(1).to_pylist(), float).reshape(b.num_rows, dim)
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            label = b.column(0).to_numpy()
            for c in total:
                own = x[label == c]
                total[c] += own.T @ own
        i, j = np.triu_indices(dim + 1)
        for c, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t[i, j])], names=["c", "i", "j", "s"])

    full = {0: np.zeros((dim + 1, dim + 1)), 1: np.zeros((dim + 1, dim + 1))}
    for r in rows.select("label", "x").mapInArrow(run, "c int, i int, j int, s double").groupBy("c", "i", "j").agg(F.sum("s").alias("s")).collect():
        full[r["c"]][r["i"], r["j"]] = full[r["c"]][r["j"], r["i"]] = r["s"]
    return {c: (t[0, 0], t[0, 1:], t[1:, 1:]) for c, t in full.items()}


class Discriminant:
    """Two normal densities with shrunk covariances. Without rows of both classes every score is ``alone``."""

    def __init__(self, m: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.1, ridge: float = 0.02, flat: float = 2.0):
        n = {c: x[0] for c, x in m.items()}
        self.alone = None if min(n.values()) >= 2 else 1.0 if n[1] >= n[0] else 0.0
        self.flat = flat
        if self.alone is not None:
            return
        self.mean = {c: s / k for c, (k, s, _) in m.items()}
        cov = {c: p / k - np.outer(self.mean[c], self.mean[c]) for c, (k, _, p) in m.items()}
        both = sum(n[c] * cov[c] for c in cov) / sum(n.values())
        self.chol, self.offset = {}, {}
        for c, s in cov.items():
            s = (1 - pooled) * s + pooled * both
            s = (1 - ridge) * s + ridge * np.diag(np.maximum(np.diag(s), 1e-6)) + 1e-6 * np.eye(len(s))
            self.chol[c] = np.linalg.cholesky(s)
            self.offset[c] = np.log(n[c] / sum(n.values())) - np.log(np.diag(self.chol[c])).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.alone is not None:
            return np.full(len(x), self.alone)
        log = {c: self.offset[c] - 0.5 * (np.linalg.solve(self.chol[c], (x - self.mean[c]).T) ** 2).sum(0) for c in self.chol}
        #: densities of many dependent statistics are too sure; ``flat`` tempers them
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.flat, -60, 60)))


def held_out(c: str):
    """Rows that are never learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(x: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """A classifier from features (doc_id, x) and labels, of all labelled rows that aren't held out.

    Null and other labels than 0 and 1 say nothing; a repeated label counts as often as it stands.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("doc_id"))
    return Discriminant(moments(x.join(known, "doc_id"), len(FEATURES)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, empty ones included.

    Only the text goes into a score. Without rows of both classes in the labels,
    all scores are 1 (0 if only class 0 is there). Null text: empty. Rows that
    repeat a doc_id are scored each; a null doc_id has no label and is not held
    out. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    x = scratch.table(features(docs))
    model = fit(x, labels, label_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = model.score(np.asarray(b.column(1).to_pylist(), float).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = x.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all columns, whose score reaches the threshold. The texts are read twice and never shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    x = scratch.table(features(docs))
    model = fit(x, labels, label_col)
    scratch.drop(x)
    place = docs.columns.index("text")

    def run(batches):
        for b in small_batches(batches, "text"):
            ok = model.score(statistics([t or "" for t in b.column(place).to_pylist()])) >= threshold
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
