"""A compressed FM-index over sequences of word hashes, searched for many patterns at once with numpy.

Words are numbered by the index's own vocabulary.  The Burrows-Wheeler transform is kept as a wavelet matrix (a bit vector a
level, with counts before each 64 bits); suffix positions are sampled, and others are found by walking back to a sample.
The words themselves are not kept beside it: all comparison is backward search.
"""

from __future__ import annotations

import pickle

import numpy as np

from .common import U64

SAMPLED = 8
#: Bits for each gram that an index holds.
GRAM_ROOM = 8


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U64) & U64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        starts = np.arange(n_symbols)
        begin = np.zeros(n_symbols, np.int64)
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            bits, zeros = Bits(bit), int(len(bit) - bit.sum())
            self.levels.append((shift, bits, zeros))
            ones = bits.ones(begin)
            begin = np.where(starts >> shift & 1, zeros + ones, begin - ones)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = begin.astype(np.uint32)  # where each symbol's run begins at the end

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before place i."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i - self.begin[symbol].astype(np.int64)

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and their ranks there."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.at(i), bits.ones(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.begin[symbol].astype(np.int64)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By doubling, until all suffixes differ; the end sorts before everything."""
    n = len(symbols)
    rank, step = symbols.astype(np.int64) + 1, 1
    while True:
        key = rank * (int(rank.max()) + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = True
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            return order
        step *= 2
        if step >= n:
            return order


class FMIndex:
    """Passages (each a sequence of 64-bit word hashes of one document) behind each other, divided by symbol 1; 0 ends them."""

    def __init__(self, passages: list[np.ndarray], docs: list[int], grams: np.ndarray = np.zeros(0, U64)):
        # two bits for each hash of a gram, by its first and its last bits: what is not there does not occur
        self.gram_bits = int(len(grams) * GRAM_ROOM).bit_length()
        seen = np.zeros(1 << self.gram_bits, bool)
        for cell in self.cells(grams):
            seen[cell] = True
        self.seen = np.packbits(seen, bitorder="little")
        self.vocabulary, numbers = np.unique(np.concatenate(passages), return_inverse=True)
        lengths = np.array([len(p) for p in passages])
        self.docs, self.firsts = np.array(docs, np.int64), np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        symbols = np.ones(int((lengths + 1).sum()) + 1, np.int64)
        symbols[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = numbers + 2
        symbols[-1] = 0
        self.size = len(symbols)
        order = suffix_array(symbols)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 2))]).astype(np.uint32)
        self.matrix = WaveletMatrix(symbols[order - 1], len(self.vocabulary) + 2)
        sampled = order % SAMPLED == 0
        self.marks, self.samples = Bits(sampled), order[sampled].astype(np.uint32)

    def dump(self) -> bytes:
        return pickle.dumps((self.gram_bits, self.seen, self.vocabulary, self.docs, self.firsts, self.size, self.count, [(s, b.words, b.before, z) for s, b, z in self.matrix.levels], self.matrix.begin, (self.marks.words, self.marks.before), self.samples))

    @classmethod
    def load(cls, blob: bytes) -> FMIndex:
        def bits(words: np.ndarray, before: np.ndarray) -> Bits:
            out = Bits.__new__(Bits)
            out.words, out.before = words, before
            return out

        self = cls.__new__(cls)
        self.gram_bits, self.seen, self.vocabulary, self.docs, self.firsts, self.size, self.count, levels, begin, marks, self.samples = pickle.loads(blob)
        self.matrix = WaveletMatrix.__new__(WaveletMatrix)
        self.matrix.levels, self.matrix.begin = [(s, bits(w, b), z) for s, w, b, z in levels], begin
        self.marks = bits(*marks)
        return self

    def cells(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = U64((1 << self.gram_bits) - 1)
        return (grams & mask).astype(np.int64), (grams >> U64(32) & mask).astype(np.int64)

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        """Which grams may occur; false only of those that don't."""
        out = np.ones(len(grams), bool)
        for cell in self.cells(grams):
            out &= (self.seen[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for unknown words."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, -1)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with the symbol (known ones only) and go on with a suffix of the range."""
        new_low, new_high = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        single = high - low == 1
        one, many = np.flatnonzero(single), np.flatnonzero(~single)
        if len(one):  # the word before a single suffix is the symbol, or there is nothing
            before, rank = self.matrix.access(low[one])
            same = before == symbol[one]
            at = one[same]
            new_low[at] = self.count[before[same]].astype(np.int64) + rank[same]
            new_high[at] = new_low[at] + 1
        if len(many):
            s, n = symbol[many], len(many)
            ranks = self.matrix.rank(np.concatenate([s, s]), np.concatenate([low[many], high[many]]))
            before = self.count[s].astype(np.int64)
            new_low[many], new_high[many] = before + ranks[:n], before + ranks[n:]
        return new_low, new_high

    def search(self, hashes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the patterns hashes[s : s + length]: those that occur, and their ranges of suffixes."""
        live = np.arange(len(starts))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        for back in range(length - 1, -1, -1):
            symbol = self.numbers(hashes[starts[live] + back])
            known = symbol >= 0
            live, low, high, symbol = live[known], low[known], high[known], symbol[known]
            if back < length - 1:
                low, high = self.step(low, high, symbol)
            else:
                low, high = self.count[symbol].astype(np.int64), self.count[symbol + 1].astype(np.int64)
            some = low < high
            live, low, high = live[some], low[some], high[some]
            if not len(live):
                break
        return live, low, high

    def matches(self, hashes: np.ndarray, begin: np.ndarray, last: np.ndarray, window: int, probe: int) -> tuple[np.ndarray, ...]:
        """Matching statistics of runs of windows, as far as they reach a window's length.

        Run i holds the windows (of so many words) that start at begin[i] to last[i].  From a run's end, words are put before the
        pattern while it occurs: that gives the longest match that ends there, so it is known of all windows in it that they
        occur.  The word that it does not go on with and those behind it, so many, are then probed by themselves; if they don't
        occur, neither does any window with all of them.  Returns each match's run, start, end (exclusive) and a suffix
        that begins with it; every window of the runs that occurs lies in a match of its run.
        """
        covered = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(covered, begin, 1)
        np.add.at(covered, last + window, -1)
        covered = np.flatnonzero(np.cumsum(covered)[:-1])
        symbols = np.full(len(hashes), -1, np.int64)
        symbols[covered] = self.numbers(hashes[covered])
        run, floor, end = np.arange(len(begin)), begin.copy(), last + window
        at, low, high = end.copy(), np.zeros(len(run), np.int64), np.full(len(run), self.size, np.int64)
        probing, undecided = np.zeros(len(run), bool), np.zeros(len(run), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        while len(run):
            symbol = symbols[at - 1]
            new_low, new_high = self.step(low, high, np.maximum(symbol, 0))
            some = (new_low < new_high) & (symbol >= 0)
            at = at - some
            low, high = np.where(some, new_low, low), np.where(some, new_high, high)
            ends = np.flatnonzero(~some | (at == np.where(probing, end - probe, floor)))
            if not len(ends):
                continue
            stop, here, probed, went = end[ends], at[ends], probing[ends], some[ends]
            long = ~probed & (stop - here >= window)
            if long.any():
                found.append((run[ends[long]], here[long], stop[long], low[ends[long]]))
            # the next window to decide: all that start behind it are decided
            following = np.where(long, here - 1, np.where(probed & went, undecided[ends], stop - 1 - window))
            again = ~probed & (stop - here > probe)
            undecided[ends], probing[ends] = following, again
            end[ends] = at[ends] = np.where(again, here - 1 + probe, following + window)
            low[ends], high[ends] = 0, self.size
            over = ends[following < floor[ends]]
            if len(over):
                run, floor, end, at, low, high, probing, undecided = (np.delete(x, over) for x in (run, floor, end, at, low, high, probing, undecided))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, row = np.arange(len(rows)), rows.copy()
        while len(live):
            there = self.marks.at(row)
            done = live[there]
            out[done] = self.samples[self.marks.ones(row[there])] + walked[done]
            live, row = live[~there], row[~there]
            if len(live):
                symbol, rank = self.matrix.access(row)
                row = self.count[symbol].astype(np.int64) + rank
                walked[live] += 1
        return out

    def doc_at(self, position: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.firsts, position, "right") - 1]
