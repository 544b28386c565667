"""Sets of hashed word shingles, computed over bytes with NumPy."""

from __future__ import annotations

import numpy as np

_BLANK = bytes(range(9, 14))
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _BLANK, bytes(range(97, 123)) + b" " * len(_BLANK))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near numbers get unrelated values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1024) - 1, _STEP | np.uint64(1), np.uint64)], dtype=np.uint64)
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` in order, A-Z lower-cased."""
    data = text.encode().translate(_LOWER)
    out, start = [], 0
    while start < len(data):
        end = data.find(b" ", start + _BLOCK)  # blocks end between words
        end = len(data) if end < 0 else end
        chars = np.frombuffer(data, np.uint8, end - start, start)
        start = end
        inside = chars != 32
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        first, last = edge[::2], edge[1::2]
        if not len(first):
            continue
        lengths = last - first
        offsets = np.r_[0, np.cumsum(lengths)[:-1]]
        place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
        terms = _VALUES[chars[inside]] * _powers(int(lengths.max()))[place]
        out.append(mix(np.add.reduceat(terms, offsets) + lengths.astype(np.uint64) * _STEP))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; with fewer words the whole sequence is the one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    total = words[:len(words) - size + 1].copy()
    for k in range(1, size):
        total = mix(total) + words[k:len(words) - size + 1 + k]
    return np.unique(mix(total))
