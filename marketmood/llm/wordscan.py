"""Word hashes of a text straight from its bytes, without a Python object per word."""

from __future__ import annotations

import numpy as np

from marketmood.llm.common import mix

_BASE = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


class WordScanner:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, alike on every machine.

    A word's hash is a polynomial in its bytes, taken as a difference of prefix sums
    and scrambled; equal words have equal hashes wherever they stand.
    """

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, _: dict) -> None:
        self.__init__()

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(2 * n, 1 << 16)
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(steps))

    def scan(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first byte, byte after the last) of each word in order."""
        raw = np.frombuffer(text or b"", np.uint8)
        n = len(raw)
        self._grow(n)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = _GAP[raw]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((raw + np.uint64(1)) * self.powers[:n], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self.inverses[starts]), starts, ends
