"""Vectorised words and rolling hashes over the bytes of many texts at once.

All hashes are polynomials modulo 2**64 over a random byte table, so that the
hash of any byte range comes from one running sum; ``mix`` (a 64-bit
finaliser) then spreads it."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse, for i < n, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def joined(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, a space after each; where each begins (and the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return (_LOWER[buf] if lower else buf), starts


def running(buf: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any range."""
    up, _ = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    return sums


def gram_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on; its high bits are the better ones."""
    _, down = powers(len(sums))
    return (sums[width:] - sums[:-width]) * down[: len(sums) - width]


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each text
    (and after the last).  Texts are parted by a space, so no word spans two."""
    edge = np.diff(_IS_SPACE[buf].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return begin, end, np.searchsorted(begin, starts)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text; runs before each text."""
    n = np.diff(bounds)
    runs = np.maximum(n - width + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(runs)))
    first = np.repeat(bounds[:-1] - offsets[:-1], runs) + np.arange(offsets[-1])
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        out = out * _U(_BASE) + hashes[first + k]
    return mix(out), offsets
