"""Words of many texts at once as 64-bit codes, by array operations over their bytes."""

from __future__ import annotations

import numpy as np

from .common import mix

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)


def _table(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if fold:
        t[65:91] = t[97:123]
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


_FOLDED, _PLAIN = _table(True), _table(False)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokeniser:
    """Codes of the words of texts; words are what bytes.split() gives, A-Z folded to a-z if asked.

    A code is the sum of a random number for each byte times a power of an odd number for its place, divided by that of
    the word's first place (odd numbers can be inverted modulo 2^64), and mixed. prefix gives the code of only the first bytes.
    """

    def __init__(self, fold: bool = True):
        self.table = _FOLDED if fold else _PLAIN
        self.power = self.inverse = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            size = max(n, 1 << 16)
            self.power = np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(size - 1, _P, _U))))
            self.inverse = np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(size - 1, _INVERSE, _U))))

    def codes(self, texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(codes, bounds, prefix codes): words of texts[i] are codes[bounds[i]:bounds[i + 1]]."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        n = len(raw)
        self._grow(n)
        space = _SPACE[raw]
        begins = ~space
        begins[1:] &= space[:-1]
        start = np.flatnonzero(begins)
        ends = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.concatenate(([0], np.searchsorted(start, ends)))
        if not len(start):
            return np.zeros(0, _U), bounds, [np.zeros(0, _U) for _ in prefixes]
        x = self.table[raw] * self.power[:n]
        back = self.inverse[start]
        codes = mix(np.add.reduceat(x, start) * back)
        more = []
        if prefixes:
            total = np.concatenate((np.zeros(1, _U), np.cumsum(x, dtype=_U)))
            stop = np.flatnonzero(space)
            word_end = stop[np.searchsorted(stop, start)]
            for k in prefixes:
                more.append(mix((total[np.minimum(start + k, word_end)] - total[start]) * back))
        return codes, bounds, more
