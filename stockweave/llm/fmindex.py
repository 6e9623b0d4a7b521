"""A compressed FM-index over word sequences, searched for many streamed sequences in step.

The sequences of a shard are joined with separators, their suffixes sorted and the Burrows-Wheeler transform kept in a
wavelet matrix: one packed bit vector with block counts for each bit of a symbol. Backward search extends a match to the
left by two rank queries. Matching statistics come from going through a stream from right to left: where a match can't
be extended, it is shortened on the right to its parent interval until it can. A match counts only if it stands in a
document smaller than the stream's own, which a range minimum over the suffixes' documents tells.
"""

from __future__ import annotations

import numpy as np

#: Matches are told apart up to this length; longer than any stream.
DEPTH = 128


class BitVector:
    """Packed bits and the ones before each block of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int32))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[block] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class RangeMin:
    """Minimum of any range in two look-ups; also the nearest smaller value on either side of a position."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))
        width = max(map(len, self.rows))
        self.table = np.full((len(self.rows), width), np.iinfo(values.dtype).max, dtype=values.dtype)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row
        self.n = len(values)

    def min(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a:b]; ranges aren't empty."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, a], self.table[k, b - (1 << k.astype(np.int64))])

    def left_end(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The largest p <= at with values[p] < floor; values[0] must be below."""
        p = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            size = 1 << k
            start = p - size + 1
            whole = (start >= 0) & (self.table[k, np.maximum(start, 0)] >= floor)
            p = np.where(whole, p - size, p)
        return p

    def right_end(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The smallest p >= at with values[p] < floor, or the length."""
        p = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            size = 1 << k
            fits = p + size <= self.n
            whole = fits & (self.table[k, np.where(fits, p, 0)] >= floor)
            p = np.where(whole, p + size, p)
        return p


class FMIndex:
    def __init__(self, sequences: list[np.ndarray], documents: np.ndarray) -> None:
        """``sequences`` of symbols from 1 up; ``documents``: the number of each one's document, in the documents' order."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        text = np.zeros(int(lengths.sum()) + len(sequences), dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        for s, at in zip(sequences, starts):
            text[at : at + len(s)] = s
        n = self.n = len(text)
        self.symbols = int(text.max()) + 1

        # suffix array by doubling; the ranks at each length also give the common prefixes
        rank = text.copy()
        ranks, size = [rank.astype(np.int32)], 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - size)] = rank[size:] + 1
            key = rank * (max(n, self.symbols) + 2) + after
            order = np.argsort(key, kind="stable")
            if 2 * size > DEPTH:
                break
            fresh = np.concatenate([[0], key[order][1:] != key[order][:-1]])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            ranks.append(rank.astype(np.int32))
            size *= 2
        common = np.zeros(n, dtype=np.int16)
        i, j = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = (i < n) & (j < n)
            same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
            common[1:][same] += 1 << k
            i, j = i + (same << k), j + (same << k)
        common[0] = -1
        self.common = RangeMin(common)
        self.lcp = np.append(common, -1)
        self.smallest = RangeMin(np.repeat(documents, lengths + 1)[order].astype(np.int32))

        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            bits = (last >> bit & 1).astype(np.uint8)
            zeros = int(n - bits.sum())
            self.levels.append((bit, BitVector(bits), zeros))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        every = np.arange(self.symbols, dtype=np.int64)
        self.base = self.descend(every, np.zeros(self.symbols, dtype=np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with the symbol, followed by those of [low, high)."""
        ends = self.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        ends = ends - np.tile(self.base[symbol] - self.first[symbol], 2)
        return ends[: len(low)], ends[len(low) :]

    def matching_statistics(self, streams: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """For each position of right-aligned streams (0 pads the left) the longest match that a smaller document holds."""
        lanes, width = streams.shape
        out = np.zeros((lanes, width), dtype=np.int16)
        low, high, length = np.zeros(lanes, np.int64), np.full(lanes, self.n, np.int64), np.zeros(lanes, np.int64)
        for column in range(width - 1, -1, -1):
            todo = np.flatnonzero(streams[:, column])
            while len(todo):
                symbol = streams[todo, column]
                a, b = self.extend(symbol, low[todo], high[todo])
                good = b > a
                good[good] = self.smallest.min(a[good], b[good]) < documents[todo[good]]
                done = todo[good]
                low[done], high[done] = a[good], b[good]
                length[done] += 1
                todo = todo[~good]
                stuck = todo[length[todo] == 0]  # no smaller document has this symbol
                low[stuck], high[stuck] = 0, self.n
                todo = todo[length[todo] > 0]
                if len(todo):
                    shorter = np.maximum(self.lcp[low[todo]], self.lcp[high[todo]]).astype(np.int64)
                    shorter = np.maximum(np.minimum(shorter, length[todo] - 1), 0)
                    low[todo] = self.common.left_end(low[todo], shorter)
                    high[todo] = self.common.right_end(np.minimum(high[todo], self.n), shorter)
                    length[todo] = shorter
            out[:, column] = length
        return out
