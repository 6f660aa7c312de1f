"""64-bit hashes of words and shingles as NumPy passes over a text's UTF-8 bytes.

A hash depends on the text alone: no seed of the process, no order of rows.  A long text is hashed in pieces that
end at white space, so memory stays in proportion to a piece and to the number of words.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD[0])
_POWERS = np.cumprod(np.full(4096, ODD[1], dtype=np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, ODD[1], dtype=np.uint64), dtype=np.uint64)


def _piece(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[b]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    b, space = b[starts[0] :], space[starts[0] :]
    starts = starts - starts[0]
    spans = np.diff(np.append(starts, len(b)))
    at = np.arange(len(b)) - np.repeat(starts, spans)
    terms = _BYTE[b] * _powers(int(at.max()) + 1)[at]
    terms[space] = 0
    return mixed(np.add.reduceat(terms, starts))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    if len(data) <= PIECE:
        return _piece(data)
    out, lo = [], 0
    while lo < len(data):
        hi = lo + PIECE
        while hi < len(data) and not _SPACE[data[hi]]:
            hi += 1
        out.append(_piece(data[lo:hi]))
        lo = hi
    return np.concatenate(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles; of fewer words, one hash of them all; of none, nothing."""
    n = min(k, len(words))
    if not n:
        return words
    run = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        run = mixed(run * ODD[2] + words[i : len(words) - n + 1 + i])
    return np.unique(run)


#: No letter or digit has a higher code point.
LAST = 0x34000
_FOLDS: dict[str, np.ndarray] = {}


def fold(kind: str) -> np.ndarray:
    """For each code point to LAST its lower case (the first of several), or 0 unless ``kind`` (a test of str) holds."""
    if kind not in _FOLDS:
        letters = [chr(c) for c in range(LAST)]
        _FOLDS[kind] = np.array([ord(x.lower()[0]) if getattr(x, kind)() else 0 for x in letters] + [0], dtype=np.uint32)
    return _FOLDS[kind]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed numbers."""
    both = [np.add.reduce(mixed(hashes * ODD[i] + ODD[4])) if len(hashes) else np.uint64(0) for i in (2, 3)]
    return tuple(int(x.astype(np.int64)) if isinstance(x, np.uint64) else int(x) for x in both)
