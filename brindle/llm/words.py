"""Words of whole texts as 64-bit hashes, computed on the UTF-8 bytes with numpy.

A word is a maximal run of bytes that are not separators. The hash of a word depends on
its (folded) bytes alone: each byte value has a random 64-bit number, positions are
weighted by powers of an odd base modulo 2**64, and a finaliser mixes the sum. Texts are
worked through in pieces that end at separators, so a long text needs little memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes worked on at a time; temporaries are some tens of times as large.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, grown when a longer piece comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, np.uint64(_inverse(int(_BASE)))))
        return self.up, self.down


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit numbers; works in place on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """Hashes of the words of texts; ``separators`` are byte values, A-Z fold to a-z."""

    def __init__(self, separators: bytes = SPACES, fold: bool = True) -> None:
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        values = np.arange(256)
        if fold:
            values[65:91] += 32
        self.value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[values] * np.uint64(2) + np.uint64(1)

    def _piece(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start bytes of the words of data; no word crosses a border."""
        n = len(data)
        word = ~self.separator[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = borders[(borders > 0) & (borders < n)]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _POWERS.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts]), starts

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For texts data[offsets[i]:offsets[i+1]]: where each text's words begin, as by ``rows`` but without hashes."""
        word = ~self.separator[data[offsets[0] : offsets[-1]]]
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = offsets - offsets[0]
        inner = at[at < len(word)]
        first[inner] = word[inner]
        return np.searchsorted(np.flatnonzero(first), at)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts data[offsets[i]:offsets[i+1]]: word hashes, start byte of each word, and where each text's words begin (one more than texts)."""
        hashes, places, at, end = [], [], int(offsets[0]), int(offsets[-1])
        while at < end:
            stop = min(end, at + PIECE)
            if stop < end:
                near = offsets[np.searchsorted(offsets, stop, "right") - 1]
                if near > at:
                    stop = int(near)
                else:  # one long text: cut before a separator
                    look, border = PIECE, int(offsets[np.searchsorted(offsets, at, "right")])
                    while True:
                        gaps = np.flatnonzero(self.separator[data[at + 1 : min(border, at + look)]])
                        if len(gaps) or at + look >= border:
                            stop = at + 1 + int(gaps[-1]) if len(gaps) and at + look < border else border
                            break
                        look *= 2
            lo, hi = np.searchsorted(offsets, [at, stop])
            h, s = self._piece(data[at:stop], offsets[lo:hi] - at)
            hashes.append(h)
            places.append(s + at)
            at = stop
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        s = np.concatenate(places) if places else np.zeros(0, np.int64)
        return h, s, np.searchsorted(s, offsets)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def windows(hashes: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and where each text's runs begin.

    A run has its first word's position: runs of text i are those that start at
    borders[i] .. borders[i+1] - width.
    """
    total = len(hashes) - width + 1
    counts = np.maximum(np.diff(borders) - width + 1, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    if total <= 0:
        return np.zeros(0, np.uint64), begins
    sums = np.zeros(total, np.uint64)
    odd = np.random.default_rng(7919).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(width):
        sums += hashes[k : k + total] * odd[k]
    where = np.arange(begins[-1]) + np.repeat(borders[:-1] - begins[:-1], counts)
    return mix(sums[where]), begins
