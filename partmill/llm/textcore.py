"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of ASCII letters, digits, ``_`` and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_WORD = np.zeros(256, dtype=np.uint8)
for _a, _b in ((48, 57), (65, 90), (95, 95), (97, 122), (128, 255)):
    _WORD[_a : _b + 1] = 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; a longer word makes its piece longer.
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _PIECE + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _hash_piece(a: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(a) + 1)
    total = np.empty(len(a) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[a] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and where each text's words begin (one entry more than texts)."""
    blobs = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(blobs) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in blobs], out=bounds[1:])
    a = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    inside = _WORD[a]
    hashes, starts, lo = [], [], 0
    while lo < len(a):
        hi = min(lo + _PIECE, len(a))
        if hi < len(a) and inside[hi - 1]:
            gap = np.flatnonzero(inside[hi:] == 0)[:1]  # the buffer ends with a gap
            hi += int(gap[0]) + 1
        h, s, _ = _hash_piece(a[lo:hi], inside[lo:hi])
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    starts_all = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.searchsorted(starts_all, bounds)


_PLACE = mix(np.arange(101, 165, dtype=np.uint64))


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and where each text's begin.  A text of 1 to n-1 words has one: all its words."""
    counts = np.diff(offsets)
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(out_counts, out=out_offsets[1:])
    total = max(len(words) - n + 1, 0)
    run = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        run += mix(words[k : k + total] ^ _PLACE[k])
    run = mix(run)
    out = np.empty(int(out_offsets[-1]), dtype=np.uint64)
    whole = counts >= n
    if whole.any():
        first, size = offsets[:-1][whole], out_counts[whole]
        shift = np.repeat(first - (np.cumsum(size) - size), size)
        at = np.arange(int(size.sum())) + shift
        to = np.repeat(out_offsets[:-1][whole] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[to] = run[at]
    for d in np.flatnonzero((counts > 0) & ~whole):
        w = words[offsets[d] : offsets[d + 1]]
        out[out_offsets[d]] = mix((mix(w ^ _PLACE[: len(w)])).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, out_offsets


def pieces(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` characters together, or one row."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
