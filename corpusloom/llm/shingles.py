"""Word-shingle sets as sorted arrays of 64-bit hashes, and exact bounds on their difference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once, and bytes of texts taken together.
_PART, _TOGETHER = 1 << 20, 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, from a sum over its bytes, each times a number that stands for its place."""
    if not len(raw):
        return _EMPTY, np.empty(0, np.int64)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return _EMPTY, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    times = mix(np.arange(1, size.max() + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    total = np.add.reduceat((_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * times[place], first)
    return mix(total + size.astype(np.uint64) * _ODD), at[first]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of any length of bytes, in parts that end at white space."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= _PART:
        return _hashed_words(data)
    hashes, starts, i = [], [], 0
    while i < len(data):
        j = min(i + _PART, len(data))
        while j < len(data) and not (cut := np.flatnonzero(_SPACE[data[j : j + _PART]])).size:
            j = min(j + _PART, len(data))
        if j < len(data):
            j += int(cut[0])
        h, s = _hashed_words(data[i:j])
        hashes.append(h)
        starts.append(s + i)
        i = j
    return np.concatenate(hashes), np.concatenate(starts)


def _sets_of(texts: list[bytes], words: int) -> list[np.ndarray]:
    h, start = _words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bound = np.concatenate(([0], np.searchsorted(start, ends)))
    run = h.copy()
    for i in range(1, words):
        run = run[:-1] * _ODD + h[i:]
        run ^= run >> np.uint64(29)
    run = mix(run + np.uint64(words))
    out = []
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        n = b - a
        if n >= words:
            s = np.sort(run[a : b - words + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif n:
            one = h[a : a + 1].copy()
            for i in range(1, n):
                one = one * _ODD + h[a + i]
                one ^= one >> np.uint64(29)
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(_EMPTY)
    return out


def shingle_sets(texts, words: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingles of each whole text, sorted, as 64-bit hashes.

    A-Z is lower-cased, words are runs without ASCII white space. A text of fewer
    words has its whole sequence as one shingle; one without words has none.
    """
    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1])
        if size > _TOGETHER:
            yield from _sets_of(held, words)
            held, size = [], 0
    if held:
        yield from _sets_of(held, words)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    return next(shingle_sets([text], words))


def set_digest(s: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return xxhash.xxh3_128_digest(s.tobytes())


def parity_bits(s: np.ndarray) -> bytes:
    """A bitmap in which each element flips one bit; it has four bits or more for each, so that few flips cancel out.

    Bits that differ between two bitmaps never outnumber the elements in which the
    sets differ, so a count above the allowed difference rules a pair out.
    """
    bits = 64
    while bits < 4 * len(s):
        bits *= 2
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bytes, as 64-bit words."""
    a = np.frombuffer(bitmap, np.uint64)
    while a.nbytes > size:
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    return a


def differences_at_least(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each pair of bitmaps, how many elements differ at least."""
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(widths), np.int64)
    for wa, wb in np.unique(widths, axis=0):
        at = np.flatnonzero((widths[:, 0] == wa) & (widths[:, 1] == wb))
        x = np.frombuffer(b"".join(a[i] for i in at), np.uint64).reshape(len(at), -1)
        y = np.frombuffer(b"".join(b[i] for i in at), np.uint64).reshape(len(at), -1)
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
