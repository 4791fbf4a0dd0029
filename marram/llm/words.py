"""Words and word n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts come from an Arrow column, so nothing is copied to Python strings. Bytes from 0x80 up belong to
characters outside ASCII, which both word rules of this package count as word characters; so words can be
told apart byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken in pieces of about so many bytes, which bounds the memory of the arrays below.
PIECE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD1342543DE82EF95)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower_table()
#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: ASCII letters and digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + (PIECE_BYTES >> 3))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (U(_BASE), U(_BASE_INVERSE)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


@dataclass
class Words:
    """Words of a run of texts: `bounds[i]:bounds[i + 1]` are the words of the i-th; null texts have none.

    `starts`, `ends` and `origin`, where each text begins, count bytes of `data`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    origin: np.ndarray

    def text(self, a: int, b: int) -> tuple[bytes, ...]:
        """Words a to b, exclusive, for checks of what the hashes say."""
        return tuple(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within one text, and a mask over words of where such a run starts."""
        n = len(self.hashes)
        starts = np.zeros(n, bool)
        if n < k:
            return np.zeros(0, U), starts
        h = self.hashes[: n - k + 1].copy()
        for j in range(1, k):
            h = h * _STEP + self.hashes[j : n - k + 1 + j]
        h = mix(h + U(k))
        counts = np.diff(self.bounds)
        last = np.repeat(self.bounds[1:], counts)  # of each word, where its text's words end
        starts = np.arange(n) + k <= last
        return h[starts[: n - k + 1]], starts


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets into the bytes of a string column, and its bytes."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def pieces(column: pa.Array, rule: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first text, text after the last, their words) over the whole column. A text is never cut."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    offsets, data = _offsets(column)
    valid = np.asarray(column.is_valid())
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield at, end, _words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], valid[at:end], rule)
        at = end


def _words(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, rule: np.ndarray) -> Words:
    data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = rule[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    cut = edges[inside[edges] & inside[edges - 1]]  # a text that starts with a word right behind another's last word
    begins[cut] = stops[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    up, down = _powers.get(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE_VALUES[data] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts]) if len(starts) else np.zeros(0, U)
    bounds = np.searchsorted(starts, offsets)
    if not valid.all():  # a null text has no bytes in Arrow files, but nothing promises it
        keep = np.repeat(valid, np.diff(bounds))
        starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
        bounds = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(bounds), 0))])
    return Words(data, starts, ends, hashes, bounds, offsets[:-1])
