"""Words of many texts at once, as arrays: positions and 64-bit hashes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240815)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: start, end (bytes in ``raw``), doc, hash."""

    def __init__(self, texts: list[str], lower: bool = True):
        joined = [x.encode("utf-8", "surrogatepass") for x in texts]
        sizes = np.asarray([len(x) + 1 for x in joined], np.int64)
        raw = b" ".join(joined) + b" "
        self.raw = np.frombuffer(raw.lower() if lower else raw, np.uint8)  # bytes.lower changes A-Z alone
        self.ends = np.cumsum(sizes) - 1  # of the texts
        gap = SPACE[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.ends, self.start)
        self.hash = self._hash()
        self.n_docs = len(texts)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each text's words

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        size = self.end - self.start
        n = int(size.sum())
        place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        letters = _LETTER[self.raw[place + np.repeat(self.start, size)]]
        h = np.add.reduceat(letters * powers(int(size.max()))[place], np.cumsum(size) - size)
        return mix(h + size.astype(np.uint64))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash), distinct and sorted: n words in a row; of a text with fewer words, all of them as one."""
        count = np.diff(self.first)
        h, doc = [], []
        m = len(self.hash)
        if m >= n:
            roll = np.zeros(m - n + 1, np.uint64)
            for k in range(n):
                roll = mix(roll * _BASE + self.hash[k : m - n + 1 + k])
            inside = self.doc[: m - n + 1] == self.doc[n - 1 :]
            h.append(roll[inside])
            doc.append(self.doc[: m - n + 1][inside])
        for d in np.flatnonzero((count > 0) & (count < n)):
            x = np.zeros(1, np.uint64) + np.uint64(count[d])
            for w in self.hash[self.first[d] : self.first[d + 1]]:
                x = mix(x * _BASE + w)
            h.append(x)
            doc.append(np.asarray([d]))
        if not h:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        return doc[keep], h[keep]
