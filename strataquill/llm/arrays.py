"""Texts of a batch as one array of code points, and hashes of all their k-grams at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, start of each text and the total length)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def owners(starts: np.ndarray) -> np.ndarray:
    """For each position the number of the text it belongs to."""
    return np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))


def kept(codes: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts without the positions where ``keep`` is false."""
    count = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return codes[keep], count[starts]


def kgrams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all windows of ``k`` symbols, in O(log k) passes over the array."""
    if len(symbols) < k:
        return np.zeros(0, U64)
    power, powers = 1, {}
    for n in range(k + 1):
        powers[n] = U64(power)
        power = power * BASE & 0xFFFFFFFFFFFFFFFF
    done, have, whole, width = 0, None, symbols.astype(U64), 1
    n = len(symbols)
    while True:
        if k & width:
            if have is None:
                have, done = whole, width
            else:
                m = n - done - width + 1
                have = have[:m] * powers[width] + whole[done : done + m]
                done += width
        if width * 2 > k:
            return have
        m = n - 2 * width + 1
        whole = whole[:m] * powers[width] + whole[width : width + m]
        width *= 2


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values."""
    if len(values) < w:
        return values[:0]
    width, out = 1, values
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = w - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def chunks(texts: Sequence[str], characters: int = 1_000_000):
    """(from, to) of stretches of ``texts`` that hold about so many characters, so that memory stays bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hash_threshold(share: float) -> int:
    """The 64-bit value below which that share of all signed hashes lies."""
    return min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 32)) * (1 << 32))
