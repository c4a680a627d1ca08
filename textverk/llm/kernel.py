"""Array kernels on code points, shared by the operators that run on Arrow batches.

A batch of texts becomes one array of code points. Folding, line and word hashes and
shingles are then whole-array operations; there is no Python loop over characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

U = np.uint64
MAX_CHARS = 1_500_000  # code points handled at once; one longer text is handled alone


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x += U(0x9E3779B97F4A7C15)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


class Fold:
    """Maps a code point to its lower-case form, or to 0 if its category is not wanted.

    The table is filled as code points turn up. Final sigma folds to sigma.
    """

    def __init__(self, categories: str) -> None:
        self.categories = categories
        self.table = np.zeros(0x110000, dtype=np.uint32)
        self.known = np.zeros(0x110000, dtype=bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        known = self.known[codes]
        if not known.all():
            for c in np.unique(codes[~known]).tolist():
                ch = chr(c)
                if unicodedata.category(ch)[0] in self.categories:
                    low = ch.lower()
                    self.table[c] = ord(low[0]) if low[0] != "ς" else ord("σ")
                self.known[c] = True
        return self.table[codes]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offsets of the texts (one more than texts)."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), off


def slices(texts: list[str], most: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``most`` characters, or one text."""
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_pow = np.ones(1, dtype=U)
_inv = np.ones(1, dtype=U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            for name, base in (("_pow", _B), ("_inv", _BINV)):
                x = np.full(n, U(base), dtype=U)
                x[0] = U(1)
                globals()[name] = np.multiply.accumulate(x)
    return _pow, _inv


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of values[start:end] for each span, equal for equal content."""
    with np.errstate(over="ignore"):
        p, inv = _powers(len(values) + 1)
        acc = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(mix(values) * p[: len(values)], out=acc[1:])
        return mix((acc[end] - acc[start]) * inv[start])


def lines_of(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text index and 1-based number of each line that has a character."""
    nl = np.flatnonzero(codes == 10)
    start = np.unique(np.concatenate([off[:-1], nl + 1]))
    start = start[start < len(codes)]
    start = start[codes[start] != 10] if len(start) else start
    rec = np.searchsorted(off, start, side="right") - 1
    before = np.searchsorted(nl, start)
    number = 1 + before - np.searchsorted(nl, off[rec])
    nxt = np.append(nl, len(codes))[before]
    end = np.minimum(nxt, off[rec + 1])
    return start, end, rec, number


def words_of(folded: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each maximal run of folded characters within a text."""
    on = folded != 0
    if not on.any():
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    edge = np.zeros(len(on), dtype=bool)
    edge[0] = on[0]
    edge[1:] = on[1:] & ~on[:-1]
    at = off[(off < len(on))]
    edge[at] |= on[at]
    start = np.flatnonzero(edge)
    stop = np.zeros(len(on) + 1, dtype=bool)
    stop[1:-1] = on[:-1] & ~on[1:]
    stop[-1] = on[-1]
    inner = off[(off > 0) & (off < len(on))]
    stop[inner] |= on[inner - 1]
    end = np.flatnonzero(stop)
    return start, end, np.searchsorted(off, start, side="right") - 1
