"""Bidirectional FM-index over a delimited vocabulary, searched many patterns at a time.

The text is ``$w1$w2 .. $wk`` read as a circle, over distinct words; ``$`` is the
least symbol. The forward index sorts all rotations, so rotations that start
with a pattern are an interval of *suffix ranks*; the words themselves come
first: rank ``r < k`` is the rotation that starts with the delimiter of the r-th
word in order. The second index does the same for the reversed text. A pattern
is held as both of its intervals, and either end can be extended by a symbol:
the extended side's interval by counting symbols before a rank, the other side's
by counting the smaller symbols that precede the occurrences.

Counts are kept for every ``STEP`` ranks and per symbol; within a step the
symbols are compared. All operations work on arrays of patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 32
DELIMITER = 0


def rotation_order(text: np.ndarray) -> np.ndarray:
    """Order of the rotations of ``text`` (no two may be equal), by prefix doubling."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order].astype(np.int64)
    width = 0
    while True:
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1:
            return order
        width = 2 * width or 1
        pair = rank * n + np.roll(rank, -width)
        order = np.argsort(pair, kind="stable")
        key = pair[order]


@dataclass
class Half:
    """One direction: the symbol before every rotation, with counts."""

    last: np.ndarray     # symbol before the rotation of each rank, padded by STEP
    counts: np.ndarray   # counts[b, c]: symbols below c among the first b * STEP ranks
    first: np.ndarray    # ranks of rotations that start below each symbol

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> Half:
        n = len(text)
        last = np.full(-(-(n + 1) // STEP) * STEP + STEP, symbols, dtype=np.uint8)
        last[:n] = text[rotation_order(text) - 1]
        blocks = len(last) // STEP
        block = np.repeat(np.arange(blocks), STEP)
        per_block = np.bincount(block * (symbols + 1) + last, minlength=blocks * (symbols + 1)).reshape(blocks, -1)
        before = np.zeros((blocks, symbols + 2), dtype=np.int32)
        before[1:, 1:] = np.cumsum(np.cumsum(per_block, axis=1), axis=0)[:-1]
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        return cls(last, before, first)

    def below(self, rank: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first ``rank`` symbols are smaller than ``symbol``, and how many equal it."""
        block, rest = rank // STEP, (rank % STEP).astype(np.uint8)
        near = self.last.reshape(-1, STEP)[block]
        inside = np.arange(STEP, dtype=np.uint8) < rest[:, None]
        own = symbol.astype(np.uint8)[:, None]
        less = self.counts[block, symbol].astype(np.int64)
        smaller = less + np.count_nonzero((near < own) & inside, axis=1)
        equal = self.counts[block, symbol + 1] - less + np.count_nonzero((near == own) & inside, axis=1)
        return smaller, equal

    def extend(self, low: np.ndarray, high: np.ndarray, other: np.ndarray, symbol: np.ndarray):
        """Intervals of ``symbol`` + pattern here, and the start of its interval in the other direction."""
        small_low, equal_low = self.below(low, symbol)
        small_high, equal_high = self.below(high, symbol)
        start = self.first[symbol]
        return start + equal_low, start + equal_high, other + small_high - small_low


@dataclass
class Patterns:
    """Patterns as intervals ``[low, high)`` of forward ranks and ``[back, back + high - low)`` of reverse ranks."""

    low: np.ndarray
    high: np.ndarray
    back: np.ndarray

    def take(self, at: np.ndarray) -> Patterns:
        return Patterns(self.low[at], self.high[at], self.back[at])


class Index:
    """Both directions over sorted distinct words of symbols ``1 ..`` (``symbols`` of them with the delimiter)."""

    def __init__(self, letters: np.ndarray, offsets: np.ndarray, symbols: int):
        """``letters[offsets[i]:offsets[i + 1]]`` is word i; words are in order, distinct and not empty."""
        self.symbols = symbols
        self.words = len(offsets) - 1
        self.size = len(letters) + self.words
        text = np.zeros(self.size, dtype=np.uint8)
        text[np.arange(len(letters)) + np.repeat(np.arange(1, self.words + 1), np.diff(offsets))] = letters
        self.forward = Half.of(text, symbols)
        self.reverse = Half.of(text[::-1], symbols)

    def everything(self, n: int) -> Patterns:
        """The empty pattern, ``n`` times."""
        return Patterns(np.zeros(n, np.int64), np.full(n, self.size, np.int64), np.zeros(n, np.int64))

    def extend_left(self, p: Patterns, symbol: np.ndarray) -> Patterns:
        low, high, back = self.forward.extend(p.low, p.high, p.back, symbol)
        return Patterns(low, high, back)

    def extend_right(self, p: Patterns, symbol: np.ndarray) -> Patterns:
        back, end, low = self.reverse.extend(p.back, p.back + p.high - p.low, p.low, symbol)
        return Patterns(low, low + end - back, back)

    def neighbours(self, p: Patterns, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, symbol) of the letters that may follow on that side, the delimiter apart.

        A small interval is read rank by rank, a large one is offered every symbol.
        """
        half, low = (self.reverse, p.back) if right else (self.forward, p.low)
        width = p.high - p.low
        narrow = np.flatnonzero(width <= self.symbols)
        wide = np.flatnonzero(width > self.symbols)
        step = np.arange(int(width[narrow].sum())) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow])
        found = half.last[np.repeat(low[narrow], width[narrow]) + step]
        pairs = np.concatenate([np.repeat(narrow, width[narrow]) * 256 + found,
                                np.repeat(wide, self.symbols - 1) * 256 + np.tile(np.arange(1, self.symbols), len(wide))])
        pairs = np.unique(pairs)
        pairs = pairs[pairs % 256 != DELIMITER]
        return pairs // 256, pairs % 256


def one_error(index: Index, letters: np.ndarray, offsets: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word rank) of indexed words that share a half of the query exactly and differ by one edit in the other.

    ``right``: the left half (length // 2 symbols) matches exactly and the search extends
    to the right; otherwise the right half matches and the search extends to the left.
    A symbol that the index does not know is ``index.symbols``. A word may be found by
    several edits and comes once; the query's own word is not returned.
    """
    length = np.diff(offsets)
    half = length // 2 if right else length - length // 2
    extend = index.extend_right if right else index.extend_left

    def symbol(query: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The symbol that the search reads at ``step``; the delimiter behind the last."""
        at = np.where(right, offsets[query] + step, offsets[query + 1] - 1 - step)
        inside = step < length[query]
        return np.where(inside, letters[np.where(inside, at, 0)] if len(letters) else 0, DELIMITER).astype(np.int64)

    def advance(query, p, step, symbols):
        known = np.flatnonzero(symbols < index.symbols)
        p = extend(p.take(known), symbols[known])
        alive = np.flatnonzero(p.high > p.low)
        return known[alive], p.take(alive)

    query = np.arange(len(length))
    exact = extend(index.everything(len(query)), np.full(len(query), DELIMITER, np.int64))
    step = np.zeros(len(query), dtype=np.int64)
    wrong = (np.zeros(0, np.int64), Patterns(*[np.zeros(0, np.int64)] * 3), np.zeros(0, np.int64))  # one error made
    ranks: list[tuple[np.ndarray, np.ndarray]] = []
    while len(query) or len(wrong[0]):
        # the error falls in the far half: a word that inserts, replaces or lacks a symbol here
        far = np.flatnonzero(step >= half[query])
        of, letter = index.neighbours(exact.take(far), right)
        q, s = query[far][of], step[far][of]
        to = extend(exact.take(far[of]), letter)
        own = symbol(q, s)
        replaced = np.flatnonzero((letter != own) & (s < length[q]))
        lacking = far[step[far] < length[query[far]]]
        born_q = np.concatenate([q, q[replaced], query[lacking]])
        born_s = np.concatenate([s, s[replaced] + 1, step[lacking] + 1])
        born = [np.concatenate([getattr(to, k), getattr(to.take(replaced), k), getattr(exact.take(lacking), k)])
                for k in ("low", "high", "back")]
        wq = np.concatenate([wrong[0], born_q])
        wp = Patterns(*[np.concatenate([getattr(wrong[1], k), b]) for k, b in zip(("low", "high", "back"), born)])
        ws = np.concatenate([wrong[2], born_s])
        # both kinds read the next symbol; behind the delimiter a word is complete
        done = ws >= length[wq]
        kept, wp = advance(wq, wp, ws, symbol(wq, ws))
        finished = done[kept]
        ranks.append((wq[kept][finished], wp.low[finished]))
        go_on = np.flatnonzero(~finished)
        wrong = (wq[kept][go_on], wp.take(go_on), ws[kept][go_on] + 1)
        more = np.flatnonzero(step < length[query])
        kept, exact = advance(query[more], exact.take(more), step[more], symbol(query[more], step[more]))
        query, step = query[more][kept], step[more][kept] + 1
    q, r = np.concatenate([x[0] for x in ranks]), np.concatenate([x[1] for x in ranks])
    pair = np.unique(q * max(index.words, 1) + r)
    return pair // max(index.words, 1), pair % max(index.words, 1)
