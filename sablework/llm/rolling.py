"""Vectorised 64-bit hashes of words and of runs of words or bytes, for use inside tasks.

A run's hash comes from prefix sums: with odd r, sum(v[i] * r^i) over the run
times r^-start (all modulo 2^64) depends on the run's values alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 2**64)
#: A random 64-bit value per byte.
BYTE_VALUES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=U64)
#: The white space that parts words: space and 0x09 to 0x0D.
SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = {"r": np.ones(1, U64), "inv": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i for i below n."""
    if len(_powers["r"]) < n:
        for name, base in (("r", _R), ("inv", _R_INV)):
            full = np.full(n + n // 2, base, U64)
            full[0] = 1
            _powers[name] = np.cumprod(full, dtype=U64)
    return _powers["r"][:n], _powers["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all of them."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def runs(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the runs [start, end)."""
    _, inv = powers(len(prefixes))
    return mix((prefixes[ends] - prefixes[starts]) * inv[starts])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words."""
    starts, ends = word_spans(raw)
    return starts, ends, runs(prefix(BYTE_VALUES[raw]), starts, ends)


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes, at least one text each."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts parted by spaces as one array of bytes, and where each of them starts (one more for the end)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Per window of ``width`` consecutive values the position of its smallest (ties: the leftmost one)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(values), dtype=np.int32 if len(values) < 2**31 else np.int64)
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        a, b = low[:-step], low[step:]
        right = b < a
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, b, a)
        have += step
    return at
