"""Runs: maximal stretches of words that repeat with a period, found by internal pattern matching.

For every length L = 2, 4, 8, ... the words of a text are cut into blocks of L. A run of period q and at least 4q words holds a whole
block of the largest L with 2L <= 3q + 1, and the block occurs again q words later, hence within (4L - 1) / 3 words. So each block asks for its
next occurrences in that window: the block's occurrences are an interval of the suffix array, and a wavelet tree over the
array gives the successor of a place within an interval. Occurrences at most L / 2 apart form a progression whose difference is
the block's own period; candidate periods are that difference, and the distances between the first, and between the last,
members of the progressions in the window. Every candidate is extended both ways and kept if the stretch is long enough.

A text is handled whole, many texts at once, in numpy arrays of about 60 bytes a word and level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marram.llm.common import extend

#: A run has at least so many words, and so many times its period. The choice of blocks rests on an exponent of 4.
LEAST_LENGTH = 6
EXPONENT = 4
#: Texts are taken in pieces of about so many bytes; a text is never cut.
PIECE_BYTES = 1 << 20

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Index(dict):
    """Numbers things in the order in which they are met."""

    def __missing__(self, key: bytes) -> int:
        self[key] = found = len(self)
        return found


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: for each, where its group of equal ones begins, and the size of that group."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begins, len(keys)))
    return np.repeat(begins, sizes), np.repeat(sizes, sizes)


class _Suffixes:
    """Suffix arrays of several texts, one behind the other, and the blocks whose words occur again in their text.

    `ranks[k]` gives equal numbers to equal stretches of 2**k words of one text, and only to these. `places` is the suffix array cut down to the
    stretches of two words that are repeated, as places within their texts; the blocks' intervals [low, high) are places of it."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        n, sizes = len(ids), np.diff(bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = bounds[text], bounds[text + 1]
        keys = text * (int(ids.max()) + 1) + ids
        order = np.argsort(keys, kind="stable")
        first, size = _groups(keys[order])
        rank = np.empty(n, np.int64)
        rank[order] = first
        self.ranks = [rank.astype(np.int32)]
        active = order[size > 1]
        length, widest = 1, (0.75 * sizes.max() + 1) / 2
        blocks: list[np.ndarray] = []
        repeated = np.zeros(0, np.int64)
        while len(active) and 2 * length <= widest:
            behind = active + length
            second = np.where(behind < self.end[active], rank[np.minimum(behind, n - 1)], -1)
            keys = rank[active] * (n + 1) + second + 1
            order = np.argsort(keys, kind="stable")
            active, keys = active[order], keys[order]
            old, _ = _groups(rank[active])
            slot = rank[active] + np.arange(len(active)) - old  # of each, its place in the suffix array
            first, size = _groups(keys)
            rank[active] = slot[first]
            self.ranks.append(rank.astype(np.int32))
            length *= 2
            again = size > 1
            active, size = active[again], size[again]
            if length == 2:
                repeated = active
            own = ((active - self.begin[active]) % length == 0) & (active + length <= self.end[active])
            blocks.append(np.stack([active[own], rank[active[own]], size[own], np.full(own.sum(), length)]))
        slots = rank[repeated]
        if len(active):  # what still is equal lies in the order in which it was sorted
            old, _ = _groups(rank[active])
            final = rank.copy()
            final[active] += np.arange(len(active)) - old
            slots = final[repeated]
        order = np.argsort(slots)
        self.places = (repeated - self.begin[repeated])[order]
        found = np.concatenate(blocks, 1) if blocks else np.zeros((4, 0), np.int64)
        self.block, self.length = found[0], found[3]
        self.low = np.searchsorted(slots[order], found[1])
        self.high = self.low + found[2]

    def _same(self, k: int, a: np.ndarray, b: np.ndarray, fits: np.ndarray) -> np.ndarray:
        rank = self.ranks[k]
        return fits & (rank[np.where(fits, a, 0)] == rank[np.where(fits, b, 0)])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, a before b in one text."""
        end, gone = self.end[np.minimum(b, len(self.end) - 1)], np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            while True:
                more = self._same(k, a + gone, b + gone, b + gone + (1 << k) <= end)
                gone += more.astype(np.int64) << k
                if k < len(self.ranks) - 1 or not more.any():
                    break
        return gone

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words in front of a equal those in front of b, a before b in one text."""
        begin, gone = self.begin[a], np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            while True:
                at = a - gone - (1 << k)
                more = self._same(k, at, at + b - a, at >= begin)
                gone += more.astype(np.int64) << k
                if k < len(self.ranks) - 1 or not more.any():
                    break
        return gone


class _WaveletTree:
    """Values by place, for counts and order statistics of intervals; a level of it for each bit, the highest first."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = int(values.max()).bit_length() if len(values) else 0
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values of [low, high) are less than limit."""
        found = np.zeros(len(low), np.int64)
        whole = limit >> self.bits > 0
        size = high - low
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zeros, one = self.zeros[level], (limit >> bit & 1).astype(bool)
            l0, h0 = zeros[low], zeros[high]
            found += np.where(one, h0 - l0, 0)
            low, high = np.where(one, zeros[-1] + low - l0, l0), np.where(one, zeros[-1] + high - h0, h0)
        return np.where(whole, size, found)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th least value of [low, high), from 0."""
        found, n = np.zeros(len(low), np.int64), n.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            zeros = self.zeros[level]
            l0, h0 = zeros[low], zeros[high]
            one = n >= h0 - l0
            n -= np.where(one, h0 - l0, 0)
            found |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - l0, l0), np.where(one, zeros[-1] + high - h0, h0)
        return found


def _candidates(s: _Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(block, period): for each run a block of it with its period is among them."""
    tree = _WaveletTree(s.places)
    block, length, low, high = s.block, s.length, s.low, s.high
    window = (4 * length - 1) // 3
    at = block - s.begin[block] if len(block) else block
    seen = tree.below(low, high, at + 1)  # so many occurrences up to the block's own

    def occurrence(n: np.ndarray, low: np.ndarray, high: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        real = (n >= 0) & (n < high - low)
        return np.where(real, tree.nth(low, high, np.where(real, n, 0)), otherwise)

    far = at + 4 * length  # beyond every window
    near = occurrence(seen, low, high, far) - at <= window
    block, length, low, high, window, at, seen, far = (x[near] for x in (block, length, low, high, window, at, seen, far))
    shift = block - at
    next_, last = occurrence(seen, low, high, far), occurrence(seen - 2, low, high, at - 4 * length)
    period = np.where(next_ - at <= length // 2, next_ - at, np.where(at - last <= length // 2, at - last, 0))
    inside = period > 0
    # the progression of the block itself: all of the stretch around it that has the block's own period
    u = np.where(inside & (next_ - at > length // 2), block - period, block)
    from_, to = np.where(inside, block, 0), np.where(inside, block, 0)
    if inside.any():
        a, p = u[inside], period[inside]
        from_[inside], to[inside] = a - s.back(a, a + p), a + p + s.ahead(a, a + p)
    step = np.maximum(period, 1)
    first = np.where(inside, at - step * ((block - from_) // step), at)
    final = np.where(inside, at + step * ((to - length - block) // step), at)
    found = [(block, period)]
    n = seen + np.where(inside, (final - at) // step, 0)
    for _ in range(2):  # gaps between progressions exceed L / 2, so a window meets two more at most
        head = occurrence(n, low, high, far)
        after = occurrence(n + 1, low, high, far + 4 * length)
        period = np.where((head - at <= window) & (after - head <= length // 2), after - head, 0)
        inside, tail = period > 0, head.copy()
        if inside.any():
            a, p = head[inside] + shift[inside], period[inside]
            tail[inside] += p * ((p + s.ahead(a, a + p) - length[inside]) // p)
        found += [(block, period), (block, head - first), (block, tail - final)]
        n = n + 1 + np.where(inside, (tail - head) // np.maximum(period, 1), 0)
    blocks, periods = (np.concatenate(x) for x in zip(*found))
    windows = np.tile(window, len(found))
    good = (periods > 0) & (periods <= windows) & (blocks + periods < s.end[blocks])
    pairs = np.unique(np.stack([blocks[good], periods[good]]), axis=1)
    return pairs[0], pairs[1]


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Runs of several texts, as rows (text, start, length, period) in this order. `ids[bounds[i]:bounds[i + 1]]` are the words of text i
    as numbers; starts count from its first word."""
    if not len(ids):
        return np.zeros((0, 4), np.int64)
    s = _Suffixes(ids.astype(np.int64), bounds.astype(np.int64))
    a, q = _candidates(s)
    start, stop = a - s.back(a, a + q), a + q + s.ahead(a, a + q)
    long = stop - start >= np.maximum(LEAST_LENGTH, EXPONENT * q)
    start, stop, q = start[long], stop[long], q[long]
    order = np.lexsort([q, stop, start])  # a stretch that has several periods counts with the least, which divides the others
    start, stop, q = start[order], stop[order], q[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, q = start[fresh], stop[fresh], q[fresh]
    rows = np.stack([np.searchsorted(bounds, start, "right") - 1, start - s.begin[start], stop - start, q], 1)
    return rows[np.lexsort([rows[:, 3], rows[:, 1], rows[:, 0]])]


def _collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: what stays of each run is its first period, unless another run drops that too."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edges, runs[:, 1] + runs[:, 2], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def _pieces(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of runs of texts; bytes.split() without an argument splits at ASCII white space, which is the rule."""
    piece, size = [], 0
    for text in texts:
        piece.append((text or b"").split())
        size += len(text or b"")
        if size >= PIECE_BYTES:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _make(column: pa.Array) -> list[pa.Array]:
    counts, collapsed, found, offsets = [], [], [], [np.zeros(1, np.int64)]
    for piece in _pieces(column.cast(pa.binary()).to_pylist()):
        index, sizes = _Index(), np.array([len(w) for w in piece], np.int64)
        ids = np.fromiter((i for w in piece for i in map(index.__getitem__, w)), np.int64, int(sizes.sum()))
        runs = find_runs(ids, np.concatenate([[0], np.cumsum(sizes)]))
        cuts = np.searchsorted(runs[:, 0], np.arange(len(piece) + 1))
        counts.append(sizes)
        collapsed += [b" ".join(_collapse(w, runs[a:b]) if b > a else w) for w, a, b in zip(piece, cuts[:-1], cuts[1:])]
        found.append(runs)
        offsets.append(offsets[-1][-1] + cuts[1:])
    runs = np.concatenate([*found, np.zeros((0, 4), np.int64)])
    rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
    return [
        pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64()),
        pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), rows),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs and collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`. runs lists (start, length, period), by start and then period, of every stretch of words with
    least period q (words q apart are identical) and at least max(6, 4q) words that no neighbouring word extends. collapsed is the text's words
    joined by single spaces, without those that lie in a run behind its first q words.

    A null text counts as empty: no words, no runs, an empty collapsed text. Texts are whole, of any length; all rows,
    repeated ones too, and all other columns pass through, but columns of docs with the new names give way. No rows give no rows."""
    return extend(docs, text_col, f"n_words long, runs array<{RUN}>, collapsed string", _make)
