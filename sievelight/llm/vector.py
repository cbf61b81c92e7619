"""Whole-batch text kernels on numpy: tokens and shingles of many texts at once.

A batch of texts becomes one byte buffer; token borders come from a class table and token hashes from prefix sums
of a polynomial over the buffer, so no Python loop runs over tokens. All hashes are 64-bit and the same in every
process. Empty and null texts have no tokens."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


_BLOCK = 1 << 20


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(_BLOCK, base)
    p[0] = U(1)
    with np.errstate(over="ignore"):
        return np.cumprod(p)


_POWERS, _INVERSE = _powers(_BASE), _powers(_BASE_INV)


def tokens(texts: list[bytes], classes: np.ndarray = _ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document number, start and end byte of each maximal run of bytes in ``classes``; start and end count
    in the texts joined by one line feed."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = classes[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    s, e = edge[::2], edge[1::2]  # the last byte is a line feed, so every run has an end
    h = np.empty(len(s), U)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(s):
            lo = s[i]
            j = max(i + 1, int(np.searchsorted(e, lo + _BLOCK, side="right")))
            n = int(e[j - 1] - lo)
            p, q = (_POWERS, _INVERSE) if n <= _BLOCK else (_long_powers(_BASE, n), _long_powers(_BASE_INV, n))
            total = np.empty(n + 1, U)
            total[0] = 0
            np.cumsum((buf[lo : lo + n] + U(1)) * p[:n], out=total[1:])
            a, b = s[i:j] - lo, e[i:j] - lo
            h[i:j] = (total[b] - total[a]) * q[a] + (b - a).astype(U)
            i = j
    each = np.diff(np.searchsorted(s, ends), prepend=0)
    return mix(h), np.repeat(np.arange(len(texts)), each), s, e


def _long_powers(base: np.uint64, n: int) -> np.ndarray:
    """For a single run longer than a block."""
    p = np.full(n, base)
    p[0] = U(1)
    return np.cumprod(p)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first token number of each run of k consecutive tokens of one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = x * _BASE + h[i : n + i]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(x[at]), doc[at], at


#: Bits of a hash that ``distinct`` keeps; the rest of the 64 number the document.
KEPT = 50


def distinct(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, upper KEPT bits of x), sorted by doc and then by x, by one sort of packed numbers; fewer than
    2**14 documents."""
    packed = (doc.astype(U) << U(KEPT)) | (x >> U(64 - KEPT))
    packed.sort()
    keep = np.ones(len(packed), bool)
    keep[1:] = packed[1:] != packed[:-1]
    packed = packed[keep]
    return packed & U((1 << KEPT) - 1), (packed >> U(KEPT)).astype(np.int64)


def lowered(texts: list[str | None]) -> list[bytes]:
    """Lower-cased UTF-8 of each text; null is empty; unpaired surrogates become question marks."""
    return [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
