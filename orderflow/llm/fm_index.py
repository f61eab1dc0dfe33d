"""An FM-index over sequences of whole numbers, searched backwards for many patterns at once.

The Burrows-Wheeler transform is kept in a wavelet matrix of packed bits: a symbol's
rank takes one step per bit of the alphabet, each a lookup of a block count and a
count of bits in one word. All functions take arrays, so that numpy does the steps of
all searches together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in sorted order, by ranks of doubled length. The zeros that end sequences are told apart by their places,
    so no comparison goes beyond a sequence's end."""
    n = len(text)
    zero = text == 0
    zeros = int(zero.sum())
    first = text + max(zeros - 1, 0)
    first[zero] = np.arange(zeros)
    # the first ranks are those of as many symbols as a number holds
    base = int(first.max()) + 2
    rank, length = first + 1, 1
    while length < n and base ** (length + 1) < 1 << 62:
        rank = rank * base
        rank[: n - length] += first[length:] + 1
        length += 1
    while True:
        order = np.argsort(rank)
        ordered = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        rank *= n + 1
        rank[: n - length] += rank[length:] // (n + 1) + 1
        length *= 2


#: The bits below each place of a word.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Symbols below a bound in packed bit rows, the highest bit first."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.size = len(symbols)
        self.levels = max(1, int(alphabet - 1).bit_length())
        blocks = self.size // 64 + 1
        self.words = np.zeros((self.levels, blocks), np.uint64)
        self.ones = np.zeros((self.levels, blocks), np.int32)
        self.zeros = np.zeros(self.levels, np.int32)
        now = symbols
        for level in range(self.levels):
            bits = (now >> (self.levels - 1 - level) & 1).astype(bool)
            packed = np.zeros(blocks * 8, np.uint8)
            part = np.packbits(bits, bitorder="little")
            packed[: len(part)] = part
            self.words[level] = packed.view("<u8")
            counts = np.bitwise_count(self.words[level]).astype(np.int32)
            self.ones[level] = np.cumsum(counts) - counts
            self.zeros[level] = self.size - int(bits.sum())
            now = np.concatenate([now[~bits], now[bits]])

    def down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the places of the row stand among the symbols' own after all levels. Both int32."""
        for level in range(self.levels):
            block = places >> 6
            ones = np.bitwise_count(self.words[level].take(block) & BELOW.take(places & 63)) + self.ones[level].take(block)
            bit = (symbols >> (self.levels - 1 - level) & 1).astype(bool)
            places = np.where(bit, ones + self.zeros[level], places - ones)
        return places


class FMIndex:
    """Index of several sequences of symbols from 1 up. An occurrence counts as often as its sequence weighs."""

    def __init__(self, sequences: Sequence[np.ndarray], weights: np.ndarray):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.text = np.zeros(int(lengths.sum()) + len(lengths), np.int64)  # 0 ends each sequence
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        inside = np.ones(len(self.text), bool)
        inside[self.ends] = False
        self.text[inside] = np.concatenate(sequences)
        order = suffix_order(self.text)
        alphabet = int(self.text.max()) + 1
        self.text = self.text.astype(np.int32)
        self.row = WaveletMatrix(self.text[order - 1], alphabet)
        counts = np.bincount(self.text, minlength=alphabet)
        symbols = np.arange(alphabet, dtype=np.int32)
        #: what turns a place after all levels into a place among the sorted suffixes
        self.shift = (np.cumsum(counts) - counts).astype(np.int32) - self.row.down(symbols, np.zeros(alphabet, np.int32))
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner[order]])])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges after putting a symbol in front of each pattern."""
        both = np.concatenate([symbols, symbols])
        places = self.row.down(both, np.concatenate([low, high])) + self.shift[both]
        return places[: len(low)], places[len(low) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


FIRST, ANCHOR, FURTHER = 0, 1, 2


def repeated_windows(index: FMIndex, window: int, anchors: np.ndarray, anchor_length: int, least: int = 2) -> list[np.ndarray]:
    """For each sequence which of its windows (all of them hold its anchor) occur least times, as booleans by start.

    Matching statistics from the right: the longest match that ends at the sequence's
    end settles all windows inside it. Where it stops short, the next end is the last one
    that a window not yet settled can have. How far the anchor can be extended to the
    left, searched once, bounds the starts worth a look. Every sequence goes on to its
    next search by itself; one step of all searches is one pass over the arrays.
    """
    starts, ends = index.starts, index.ends
    size = np.int32(len(index.text))
    marks = np.zeros(len(index.text) + 1, np.int64)
    who = np.flatnonzero(ends - starts >= window)
    right, stop = ends[who].copy(), starts[who].copy()
    left, waiting, phase = right.copy(), right.copy(), np.full(len(who), FIRST)
    low, high = np.zeros(len(who), np.int32), np.full(len(who), size, np.int32)
    while len(who):
        low, high = index.extend(index.text[left - 1], low, high)
        again = index.occurrences(low, high) >= least
        left = left - again
        ended = ~again | (left <= stop)
        if not ended.any():
            continue
        live = np.ones(len(who), bool)
        at = np.flatnonzero(ended & (phase != ANCHOR))
        found = at[right[at] - left[at] >= window]
        np.add.at(marks, left[found], 1)
        np.add.at(marks, right[found] - window + 1, -1)
        live[at[left[at] <= stop[at]]] = False
        at = at[left[at] > stop[at]]
        following = np.minimum(right[at] - 1, left[at] + window - 1)
        first = phase[at] == FIRST
        anchor = np.flatnonzero(ended & (phase == ANCHOR))
        # from the first search to the anchor's; the end to go on with waits
        go = at[first]
        waiting[go] = following[first]
        left[go] = starts[who[go]] + anchors[who[go]] + anchor_length
        phase[go] = ANCHOR
        # from the anchor's search, and from further ones, to the next end
        stop[anchor] = left[anchor]
        live[anchor[stop[anchor] > (starts + anchors)[who[anchor]]]] = False
        right[anchor], phase[anchor] = waiting[anchor], FURTHER
        right[at[~first]] = following[~first]
        restart = np.concatenate([anchor, at[~first]])
        left[restart] = right[restart]
        live[restart[right[restart] - stop[restart] < window]] = False
        fresh = np.concatenate([restart, go])
        low[fresh], high[fresh] = 0, size
        if not live.all():
            who, right, left, stop, waiting, phase, low, high = (x[live] for x in (who, right, left, stop, waiting, phase, low, high))
    repeated = np.cumsum(marks) > 0
    return [repeated[s : max(s, e - window + 1)] for s, e in zip(starts, ends)]
