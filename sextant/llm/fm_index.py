"""A compressed FM-index over word sequences: backward search on a wavelet matrix.

The index sorts the suffixes of a sequence by their first ``ORDER`` words, enough for
patterns shorter than that, and keeps of it the wavelet matrix of the Burrows-Wheeler
transform (packed bits with sampled ranks), symbol counts and the common prefix lengths.
Searches run for many patterns at once, one word a step.
"""

from __future__ import annotations

import numpy as np

#: Words by which suffixes are sorted; longer patterns aren't searched.
ORDER = 64


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, current = bits, [], symbols
        for b in reversed(range(bits)):
            one = (current >> b & 1).astype(bool)
            padded = np.zeros(-(-(len(one) + 1) // 64) * 64, bool)
            padded[: len(one)] = one
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1])).astype(np.int32)
            self.levels.append((words, before, int(len(one) - one.sum())))
            current = np.concatenate((current[~one], current[one]))
        every = np.arange(1 << bits, dtype=np.int64) if bits <= 22 else None
        self.first = self._walk(every, np.zeros(len(every), np.int64)) if every is not None else None

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, before, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> level & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = self.first[symbols] if self.first is not None else self._walk(symbols, np.zeros_like(at))
        return self._walk(symbols, at) - start


class FMIndex:
    """Of ``text``, a sequence of symbols 1, 2, ... in which 0 ends each member sequence."""

    def __init__(self, text: np.ndarray, threshold: int):
        assert 0 < threshold < ORDER
        n = len(text)
        rank = text.astype(np.int64)
        ranks, size = [rank], 1
        while size < ORDER:
            ahead = np.full(n, -1, np.int64)
            ahead[: n - size] = rank[size:]
            key = rank * (n + int(text.max(initial=0)) + 2) + ahead + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            ranks.append(rank)
            size *= 2
        self.suffixes = order.astype(np.int32 if n < 1 << 31 else np.int64)
        self.threshold, self.n = threshold, n
        # Common prefix with the row before, up to ORDER words, by halving over the kept ranks.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, n - 1), np.int16)
        for r, step in zip(reversed(ranks), (1 << i for i in reversed(range(len(ranks)))), strict=True):
            inside = (a < n) & (b < n)
            same = inside.copy()
            same[inside] = r[a[inside]] == r[b[inside]]
            common[same] += step
            a[same] += step
            b[same] += step
        self.common = np.concatenate(([-1], common))
        starts = np.flatnonzero(self.common < threshold)
        #: Rows that share their first ``threshold`` words are one class, a range of rows.
        self.row_class = (np.cumsum(self.common < threshold) - 1).astype(np.int32)
        self.class_start, self.class_end = starts, np.concatenate((starts[1:], [n]))
        self.symbols = int(text.max(initial=0)) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.symbols))))
        self.bwt = WaveletMatrix(text[(order - 1) % n].astype(np.int64), max(1, int(self.symbols - 1).bit_length()))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges after one more word in front of each pattern; unknown words (negative) give empty ranges."""
        known = (symbols >= 0) & (symbols < self.symbols)
        safe = np.where(known, symbols, 0)
        found = self.bwt.rank(np.concatenate((safe, safe)), np.concatenate((low, high)))
        base = self.before[safe]
        lo, hi = base + found[: len(low)], base + found[len(low) :]
        return np.where(known, lo, 0), np.where(known, hi, 0)

    def _shorter(self, symbol: int, row: int, length: int) -> tuple[int, int, int]:
        """The longest prefix of the pattern at ``row`` that has an occurrence after ``symbol``: its range with that symbol and new length."""
        low = high = row
        while length > 0:
            low, high = row, row + 1
            while low > 0 and self.common[low] >= length:
                low -= 1
            while high < self.n and self.common[high] >= length:
                high += 1
            lo, hi = self.extend(np.array([symbol]), np.array([low]), np.array([high]))
            if lo[0] < hi[0]:
                return int(lo[0]), int(hi[0]), length + 1
            length = max([x for x in (int(self.common[low]), int(self.common[high]) if high < self.n else -1)] + [0])
        lo, hi = self.extend(np.array([symbol]), np.array([0]), np.array([self.n]))
        return (int(lo[0]), int(hi[0]), 1) if lo[0] < hi[0] else (0, self.n, 0)

    def match(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Matching statistics, capped at the threshold, of the patterns flat[start:end].

        Returns for every place of ``flat`` the length of the longest match of the index that
        starts there within its pattern, and where that is the threshold the class of the
        matching rows, -1 elsewhere.
        """
        length_at, class_at = np.zeros(len(flat), np.int16), np.full(len(flat), -1, np.int32)
        place = end.astype(np.int64) - 1
        low, high, length = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64), np.zeros(len(start), np.int64)
        active = np.flatnonzero(place >= start)
        while len(active):
            symbol = flat[place[active]]
            lo, hi = self.extend(symbol, low[active], high[active])
            size = length[active] + 1
            for k in np.flatnonzero(lo >= hi):
                size[k] -= 1
                if symbol[k] < 0 or symbol[k] >= self.symbols:
                    lo[k], hi[k], size[k] = 0, self.n, 0
                else:
                    lo[k], hi[k], size[k] = self._shorter(int(symbol[k]), int(low[active[k]]), int(size[k]))
            full = size >= self.threshold
            of = self.row_class[lo[full]]
            lo[full], hi[full], size[full] = self.class_start[of], self.class_end[of], self.threshold
            at = place[active]
            length_at[at] = size
            class_at[at[full]] = of
            low[active], high[active], length[active] = lo, hi, size
            place[active] -= 1
            active = active[place[active] >= start[active]]
        return length_at, class_at
