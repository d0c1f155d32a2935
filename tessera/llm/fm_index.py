"""A compressed full-text index of integer sequences: BWT in a wavelet matrix, backward search, matching statistics, sampled places."""

from __future__ import annotations

import numpy as np

#: Of so many places one is kept; the others are found by steps through the BWT.
SAMPLE = 8
#: The lower bits of a number, as many as its place in this list says.
_BELOW = (np.int64(1) << np.arange(32)) - np.int64(1)


class Bits:
    """A bit vector with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Counts of a symbol before a place, for symbols from 0 to size - 1, in a number of steps that is the symbols' number of digits of four bits.

    A level has a row for 32 places with a number for each digit: its lower half says which of the places have the digit, its
    upper half where the first of them goes in the next level's order.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        blocks = len(symbols) // 32 + 1
        for shift in reversed(range(0, max(1, int(size - 1).bit_length()), 4)):
            digits = (symbols >> shift & 15).astype(np.uint8)
            rows, begin = np.empty((blocks, 16), np.int64), 0
            for d in range(16):
                there = np.zeros(blocks * 4, np.uint8)
                packed = np.packbits(digits == d, bitorder="little")
                there[: len(packed)] = packed
                there = there.view("<u4")
                ends = begin + np.cumsum(np.bitwise_count(there), dtype=np.int64)
                rows[1:, d], rows[0, d], begin = ends[:-1], begin, int(ends[-1])
                rows[:, d] = rows[:, d] << 32 | there
            self.levels.append((shift, rows.reshape(-1), digits))
            symbols = symbols[np.argsort(digits, kind="stable")]
        self.begin = self._descend(np.arange(size), np.zeros(size, np.int64))

    @staticmethod
    def _next(rows: np.ndarray, digit: np.ndarray, at: np.ndarray) -> np.ndarray:
        both = rows[(at >> 5 << 4) + digit]
        return (both >> 32) + np.bitwise_count(both & _BELOW[at & 31])

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, rows, _ in self.levels:
            at = self._next(rows, symbol >> shift & 15, at)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how many like it are before."""
        symbol = np.zeros(len(at), np.int64)
        for shift, rows, digits in self.levels:
            digit = digits[at].astype(np.int64)
            symbol |= digit << shift
            at = self._next(rows, digit, at)
        return symbol, at - self.begin[symbol]


class FMIndex:
    """The index of sequences of positive integers, joined with 0 between them.

    It knows matches up to a given length: suffixes are ordered by their first 32 symbols, which is enough for matches of up
    to 31. Kept are the wavelet matrix of the BWT, where each symbol's suffixes begin, the capped lengths that neighbours in
    suffix order have in common (a byte each), and one place in SAMPLE. Suffixes that end with the text are in order of
    their places.
    """

    def __init__(self, text: np.ndarray, most: int):
        if not 1 <= most <= 31:
            raise ValueError("matches of 1 to 31 symbols are known")
        n, self.most = len(text), most
        self.size = int(text.max()) + 1
        rank = text
        ranks, width = {1: rank}, 1
        while width < 32:
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            rank = np.unique(rank * (max(n, self.size) + 1) + after, return_inverse=True)[1]
            width *= 2
            ranks[width] = rank
        places = np.argsort(rank, kind="stable")
        a, b, common = places[:-1], places[1:], np.zeros(max(0, n - 1), np.int64)
        for width in (16, 8, 4, 2, 1):
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            common += width * (inside & (ranks[width][np.minimum(x, n - 1)] == ranks[width][np.minimum(y, n - 1)]))
        #: What the suffixes on both sides of a border share; the outer borders share nothing.
        self.shared = np.zeros(n + 1, np.uint8)
        self.shared[1:n] = np.minimum(common, most)
        self.first = np.zeros(self.size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.size), out=self.first[1:])
        before = text[places - 1]
        self.matrix = WaveletMatrix(before, self.size)
        self.n, self._borders = n, {}
        self._sample(places, before)

    def _sample(self, places: np.ndarray, before: np.ndarray) -> None:
        """Keep one place in SAMPLE, and those from which a step through the BWT would not come to the suffix one place before: suffixes with 32 equal symbols are not told apart by what follows."""
        order, stepped = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        order[places] = np.arange(self.n)
        stepped[np.argsort(before, kind="stable")] = np.arange(self.n)
        kept = (places % SAMPLE == 0) | (stepped != order[places - 1])
        self.sampled, self.kept_places = Bits(kept), places[kept].astype(np.int32)

    def step(self, rows: np.ndarray) -> np.ndarray:
        """The suffixes that begin one symbol before."""
        symbol, before = self.matrix.access(rows)
        return self.first[symbol] + before

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where suffixes begin: steps to the next sampled one, at most SAMPLE - 1 of them."""
        place, steps, waiting = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(waiting):
            there = self.sampled.get(rows)
            place[waiting[there]] = self.kept_places[self.sampled.rank(rows[there])] + steps
            waiting, rows = waiting[~there], self.step(rows[~there])
            steps += 1
        return place

    def borders(self, depth: int) -> np.ndarray:
        """Where the groups of suffixes with this many symbols in common begin, and the end; kept with the index, so that it goes with it."""
        if depth not in self._borders:
            self._borders[depth] = np.flatnonzero(self.shared < depth)
        return self._borders[depth]

    def group(self, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        borders = self.borders(depth)
        at = np.searchsorted(borders, low, "right")
        return borders[at - 1], borders[at]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with the symbol and go on like those between low and high."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(symbol)], self.first[symbol] + both[len(symbol) :]

    def matching_statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place of the queries (symbols[start:end]; symbols unknown to the index as 0): the length of the longest match that begins there, up to most, and the interval of suffixes that have it.

        All queries are streamed together from their last symbol to their first. A match that can't be extended is cut
        at its end to the next shorter group of suffixes until it can.
        """
        length, lows, highs = np.zeros(len(symbols), np.uint8), np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
        order = np.argsort(starts - ends, kind="stable")
        ends, sizes = ends[order], (ends - starts)[order]
        low, high, have = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            k = int(np.searchsorted(-sizes, -step, "right"))
            low, high, have, at = low[:k], high[:k], have[:k], ends[:k] - step
            symbol = symbols[at].astype(np.int64)
            new_low, new_high = self.extend(symbol, low, high)
            new_low[symbol == 0] = new_high[symbol == 0] = 0
            stuck = np.flatnonzero(new_low >= new_high)
            while len(stuck):
                gone = stuck[(have[stuck] == 0) | (symbol[stuck] == 0)]
                low[gone], high[gone], have[gone] = 0, self.n, -1
                new_low[gone], new_high[gone] = 0, self.n
                stuck = stuck[have[stuck] > 0]
                depth = np.maximum(self.shared[low[stuck]], self.shared[high[stuck]])
                for d in np.unique(depth):
                    these = stuck[depth == d]
                    low[these], high[these] = self.group(low[these], int(d)) if d else (0, self.n)
                    have[these] = d
                new_low[stuck], new_high[stuck] = self.extend(symbol[stuck], low[stuck], high[stuck])
                stuck = stuck[new_low[stuck] >= new_high[stuck]]
            low, high, have = new_low, new_high, have + 1
            over = np.flatnonzero(have > self.most)
            if len(over):
                low[over], high[over] = self.group(low[over], self.most)
                have[over] = self.most
            length[at], lows[at], highs[at] = have, low, high
        return length, lows, highs

    def count(self, pattern: np.ndarray) -> int:
        low, high = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for symbol in pattern[::-1]:
            if not 0 < symbol < self.size:
                return 0
            low, high = self.extend(np.asarray([symbol]), low, high)
        return max(0, int(high[0] - low[0]))
