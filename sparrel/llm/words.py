"""Word splitting and 64-bit rolling hashes over whole texts, vectorised with numpy.

A word is a maximal run of bytes other than space and the controls 9 to 13, so a text splits the
same way as the expression ``[^\\x20\\x09-\\x0D]+``. Hashes only propose; whoever uses them compares
the words themselves, or tolerates the odds of a 64-bit collision and says so.
"""

from __future__ import annotations

import numpy as np

_IS_WORD = np.ones(256, dtype=np.int8)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = 0

_BYTE_MULT = 0x9E3779B97F4A7C15
_WORD_MULT = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as they are needed."""

    def __init__(self, mult: int) -> None:
        self.mult, self.inverse = mult, pow(mult, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            steps = np.full(size, self.mult, dtype=np.uint64), np.full(size, self.inverse, dtype=np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_bytes, _words = _Powers(_BYTE_MULT), _Powers(_WORD_MULT)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of a text: starts and exclusive ends."""
    edge = np.diff(_IS_WORD[np.frombuffer(raw, dtype=np.uint8)], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def byte_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to before its end, wherever they stand."""
    up, down = _bytes.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    values = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    np.cumsum(values * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    starts, ends = spans(raw)
    return byte_hashes(raw, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from each start to before its end."""
    up, down = _words.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive words; empty if there are fewer."""
    starts = np.arange(max(0, len(words) - width + 1))
    return span_hashes(words, starts, starts + width)
