"""Vectorised 64-bit hashes of the words of many texts at once (numpy over UTF-8 bytes)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_MULT = U(0x9E3779B97F4A7C15)
_ROLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_power = np.ones(1, np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[48:58] = _LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _MULT)]))
    return _power


class Words:
    """Words of a run of texts: ``hash``, ``start``, ``length`` of each, and ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, raws: list[bytes], letters: bool = False):
        """Words are runs of bytes other than ASCII white space; with ``letters``, of letters, digits and non-ASCII bytes."""
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        self.data = data = _LOWER[data]
        if letters:
            upper = np.zeros(len(data), bool)
            upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            data[upper] += 32
        inside = _LETTER[data] if letters else ~_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, end = edge[::2], edge[1::2]
        self.length = end - self.start
        self.at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        self.first = np.searchsorted(self.start, self.at)
        if len(self.start):
            pos = np.flatnonzero(inside)
            offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
            within = np.arange(len(pos)) - np.repeat(offset, self.length)
            terms = _BYTE[data[pos]] * powers(int(self.length.max()))[within]
            self.hash = mix(np.add.reduceat(terms, offset) + self.length.astype(np.uint64) * _ROLE[0])
        else:
            self.hash = np.zeros(0, np.uint64)

    def prefixes(self, ks: range) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each k of ``ks``: hashes of the first k bytes of the words longer than k, and which words they are."""
        out, which = [], np.arange(len(self.start))
        total = np.zeros(len(which), np.uint64)
        for i in range(ks.stop - 1):
            inside = self.length[which] > i + 1
            which, total = which[inside], total[inside]
            total = total + _BYTE[self.data[self.start[which] + i]] * powers(ks.stop)[i]
            if i + 1 >= ks.start:
                out.append((mix(total + _ROLE[24 + i]), which))
        return out

    def shingles(self, k: int) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its runs of ``k`` words; of all its words if there are fewer."""
        n = len(self.hash)
        run = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            run += self.hash[j : n - k + 1 + j] * _ROLE[2 + j]
        run = mix(run)
        out = []
        for a, b in zip(self.first[:-1], self.first[1:]):
            if b - a >= k:
                out.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                few = (self.hash[a:b] * _ROLE[20 : 20 + b - a]).sum(dtype=np.uint64) + U(b - a)
                out.append(mix(np.array([few], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
