"""Vectorised hashing of bytes, words and runs of them (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_T = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring runs. The shifts keep it from being linear, so that no pattern of repeats cancels out."""
    z = y ^ (y >> np.uint64(29))
    z *= _K2
    z += x * _K1
    z ^= z >> np.uint64(32)
    return z


class Runs:
    """Hashes of any run of consecutive units: of two overlapping runs of 2**j units, each hashed by halves."""

    def __init__(self, units: np.ndarray, level: int = 0):
        """units: hashes of single units or, with level, of each run of 2**level units."""
        self._low, self._levels, self._n = level, [units], len(units) + (1 << level) - 1 if len(units) else 0

    def _dense(self, j: int) -> np.ndarray:
        while (top := self._low + len(self._levels) - 1) < j:
            x = self._levels[-1]
            self._levels.append(_pair(x[: max(len(x) - (1 << top), 0)], x[1 << top :]))
        return self._levels[j - self._low]

    def _at(self, j: int, place: np.ndarray) -> np.ndarray:
        if j < self._low + len(self._levels):
            return self._levels[j - self._low][place]
        return _pair(self._at(j - 1, place), self._at(j - 1, place + (1 << (j - 1))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, size = np.asarray(start), np.asarray(end - start)
        out, log = np.zeros(len(size), np.uint64), np.frexp(size)[1] - 1
        for j in np.unique(log).tolist():
            k = np.flatnonzero(log == j)
            s, n = start[k], size[k]
            self._dense(max(j - 2, self._low))  # of longer runs, few are asked for
            out[k] = mix(_pair(self._at(j, s), self._at(j, s + n - (1 << j))) + n.astype(np.uint64) * _T[0])
        return out

    def each(self, k: int) -> np.ndarray:
        """The hash of every run of k units (all starts), as `of` gives it."""
        n = self._n - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        j = k.bit_length() - 1
        x = self._dense(j)
        return mix(_pair(x[:n], x[k - (1 << j) :][:n]) + np.uint64(k * int(_T[0]) % (1 << 64)))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros stand behind the end."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    out = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[k::8] = padded[k : k + (len(data) - k + 7) // 8 * 8].view("<u8")
    return out


def byte_runs(data: np.ndarray, least: int) -> Runs:
    """Runs of bytes, of which none shorter than `least` is asked for."""
    return Runs(_eights(data)[: max(len(data) - 7, 0)], 3) if least >= 8 else Runs(_T[data])


#: The white space of the word rule [^\x20\x09-\x0D]+, and the bytes of the word rule of digits, letters and non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in data, and n + 1 offsets of each row's words. No word crosses rows."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """By eight bytes at a time, each step a bijection; long words by xxhash. Another seed gives an unrelated hash."""
    import xxhash

    size = end - start
    h = mix(size.astype(np.uint64) * _K1 + _T[1 + seed])
    eight = _eights(data)
    live = np.flatnonzero(size <= LONG)
    step = 0
    while len(live := live[size[live] > step]):
        x = eight[start[live] + step]
        short = np.maximum(8 * (step + 8 - size[live]), 0).astype(np.uint64)
        h[live] = mix(h[live] ^ (x << short))
        step += 8
    raw = memoryview(data)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]], 7 + seed)
    return h


def starts_of_windows(off: np.ndarray, size: int) -> np.ndarray:
    """Starts of all windows of `size` units that lie within one row."""
    room = np.maximum(np.diff(off) - size + 1, 0)
    total = int(room.sum())
    return np.arange(total) + np.repeat(off[:-1] - (np.cumsum(room) - room), room)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the half-open intervals."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True."""
    e = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(e == 1), np.flatnonzero(e == -1)
