"""A compressed FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform, searched backwards.

Texts are kept apart by a mark that no word equals, so no match reaches from one
text into another.  Suffixes are ordered by their first ``depth`` words, which
is as far as searches go.  Searches run in lock-step: one step takes one word of
every text.
"""

from __future__ import annotations

import numpy as np


class PackedBits:
    """Bits in 64-bit words with running counts."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate((bits, np.zeros(64 + -len(bits) % 64, bool))), bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64))).astype(np.int32)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[places >> 6] + np.bitwise_count(self.words[places >> 6] & below).astype(np.int64)


class WaveletMatrix:
    """Bit levels of a sequence, most significant first, packed."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        values = values.astype(np.int32)
        self.levels: list[tuple[PackedBits, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.levels.append((PackedBits(bit), int(len(bit) - bit.sum())))
            values = np.concatenate((values[~bit], values[bit]))
        # symbols now stand in the order of their bits read backwards: where each one begins
        symbols, counts = np.unique(values, return_counts=True)
        seen = values[np.concatenate(([True], np.diff(values) != 0))] if len(values) else values
        self.begin = np.zeros(1 << bits, np.int32)
        sizes = np.zeros(1 << bits, np.int64)
        sizes[symbols] = counts
        self.begin[seen] = np.cumsum(sizes[seen]) - sizes[seen]
        self.present = sizes > 0

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        stop = places.astype(np.int64)
        for level, (packed, zeros) in enumerate(self.levels):
            ones = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            last = packed.rank(stop)
            stop = np.where(ones, zeros + last, stop - last)
        # a symbol that does not occur has nowhere to begin
        return np.where(self.present[symbols], stop - self.begin[symbols], 0)


class FmIndex:
    """An index of texts given as one array of word codes and the texts' lengths; matches are followed to ``depth`` words.

    What is kept of them is the wavelet matrix, the counts of its symbols, and of
    each group of suffixes that agree in ``depth`` words where it begins (a bit a
    place, and 4 bytes) and where its words stand first (4 bytes); neither the
    words nor the sorted suffixes.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int):
        self.depth = depth
        stops = np.cumsum(lengths)
        self.alphabet, codes = np.unique(words, return_inverse=True)
        # a mark, code 0, ends every text
        n = len(words) + len(lengths)
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[stops + np.arange(len(lengths))] = False
        text[inner] = codes + 1
        order, rank = self._sorted(text, depth)
        self.size = n
        begins = np.concatenate(([True], np.diff(rank[order]) != 0))
        self.groups = PackedBits(begins)
        firsts = np.flatnonzero(begins)
        self.group_start = np.append(firsts, n).astype(np.int32)
        #: the first place in the words of each group
        self.group_first = np.minimum.reduceat((np.cumsum(inner) - 1)[order], firsts).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))))
        self.transform = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes by their first ``depth`` words, and each one's rank, equal for equal beginnings; by doubling."""

        def joined(left: np.ndarray, right: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
            later = np.concatenate((right[shift:], np.zeros(min(shift, len(right)), np.int64)))[: len(left)]
            key = left * (int(right.max(initial=0)) + 1) + later
            order = np.argsort(key)
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], np.diff(key[order]) != 0)))
            return rank, order

        powers, length, order = [text], 1, None
        while 2 * length <= depth:
            rank, order = joined(powers[-1], powers[-1], length)
            powers.append(rank)
            length *= 2
        rank, done = powers[-1], length
        for k in range(len(powers) - 2, -1, -1):
            if done + 2**k <= depth:
                (rank, order), done = joined(rank, powers[k], done), done + 2**k
        if order is None:
            rank, order = joined(rank, np.zeros_like(rank), 0)
        return order, rank

    def step(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of matches with one more word in front."""
        ranks = self.transform.rank(np.concatenate((symbols, symbols)), np.concatenate((start, stop)))
        n = len(symbols)
        return self.before[symbols] + ranks[:n], self.before[symbols] + ranks[n:]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The code of each word, 0 for one that no indexed text has."""
        if not len(self.alphabet):
            return np.zeros(len(words), np.int64)
        where = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[where] == words, where + 1, 0)

    def first_places(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For every place of streamed texts where ``depth`` words begin, the first place with the same words in the indexed texts; -1 elsewhere.

        The streamed texts must be among the indexed ones.  Each is streamed from
        its right end.  While a match is shorter than ``depth`` a step lengthens it;
        from then on the interval is widened after each step to all matches of
        ``depth`` words, so one step a word is enough.
        """
        codes = self.codes(words)
        starts = np.cumsum(lengths) - lengths
        found = np.full(len(words), -1, np.int64)
        at = np.flatnonzero(lengths >= self.depth)
        start = stop = np.zeros(len(at), np.int64)
        for taken in range(1, int(lengths.max(initial=0)) + 1):
            going = lengths[at] >= taken
            if not going.all():
                at, start, stop = at[going], start[going], stop[going]
            place = starts[at] + lengths[at] - taken
            symbols = codes[place]
            if taken == 1:
                start, stop = self.before[symbols], self.before[symbols + 1]
            elif taken <= self.depth:
                start, stop = self.step(symbols, start, stop)
            else:
                start = self.before[symbols] + self.transform.rank(symbols, start)
            if taken >= self.depth:
                group = self.groups.rank(start + 1) - 1
                start, stop = self.group_start[group].astype(np.int64), self.group_start[group + 1].astype(np.int64)
                found[place] = self.group_first[group]
        return found

    def matching(self, words: np.ndarray) -> np.ndarray:
        """Matching statistics of any text: for each end, the words before it that the index holds in a row, at most ``depth``."""
        codes = self.codes(words)
        lengths = np.zeros(len(words), np.int64)
        ends = np.arange(len(words))
        start, stop = np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        for taken in range(self.depth):
            going = ends - taken >= 0
            going[going] = codes[ends[going] - taken] > 0
            ends, start, stop = ends[going], start[going], stop[going]
            start, stop = self.step(codes[ends - taken], start, stop)
            held = start < stop
            ends, start, stop = ends[held], start[held], stop[held]
            lengths[ends] = taken + 1
        return lengths
