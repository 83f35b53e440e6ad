"""Vectorised words and word n-grams.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text, which is the class ``[^\\x20\\x09-\\x0D]+`` on characters.  Hashes
are 64-bit polynomial hashes of a batch at once, mixed at the end; nothing here
runs a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one vectorised step takes; working arrays are about 40 times this.
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_R = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_R), _Powers(0xA0761D6478BD642F)


class Words:
    """Words of a run of texts: ``hash``, byte span ``start``/``end`` in ``data``, and ``first[i]:first[i+1]`` of text i."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, lower: bool) -> None:
        data = _LOWER[data] if lower else data
        self.data = data
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[:-1] = inside
        edge[1:] ^= inside
        edge[0] = len(data) > 0 and inside[0]
        begins = np.zeros(len(data) + 1, bool)
        begins[:-1] = inside & edge[:-1]
        ends = edge & ~begins
        at = cuts[1:-1]
        at = at[(at > 0) & (at < len(data))]
        cut = at[inside[at] & inside[at - 1]]  # two texts meet without white space
        begins[cut] = True
        self.start = np.flatnonzero(begins)
        ends[cut] = True
        self.end = np.flatnonzero(ends)
        up, down = _BYTES.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, cuts)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base of word sequences, and of its inverse."""
        return _WORDS.get(n)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position (0 where they don't fit into the text), and whether they fit."""
        m = len(self.hash)
        fits = np.zeros(m, bool)
        if m < n:
            return np.zeros(m, U), fits
        up, down = _WORDS.get(m + 1)
        sums = np.zeros(m + 1, U)
        np.cumsum(self.hash * up[:-1], out=sums[1:])
        out = np.zeros(m, U)
        k = m - n + 1
        out[:k] = mix((sums[n:] - sums[:k]) * down[:k] + U(n))
        last = np.repeat(self.first[1:], np.diff(self.first))
        fits[:] = np.arange(m) + n <= last
        return out, fits


def pieces(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for runs of whole texts of about STEP_BYTES; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
        yield row, end, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower)
        row = end
