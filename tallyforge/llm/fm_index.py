"""A bidirectional FM-index over word ids, for counting phrases of a few words.

The text is an array of symbols from 1; 0 separates pieces and ends the text.
Rows are the positions of the text in the order of the ``DEPTH`` symbols that
start there, so the rows of a phrase of up to that length are one interval.
The last column holds the symbol before each row; ranks in it lead from the
interval of a phrase to those of the phrases with one more word in front.  The
same over the reversed text adds words behind, and both intervals of a phrase
are kept in step.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Phrases up to this length have intervals.
DEPTH = 8


class Intervals(NamedTuple):
    """Phrases: first row forward, first row backward, occurrences."""

    low: np.ndarray
    back: np.ndarray
    n: np.ndarray


class Grown(NamedTuple):
    """Phrases with one more word, and which of the given ones they begin and end with."""

    intervals: Intervals
    prefix: np.ndarray
    suffix: np.ndarray


def last_column(text: np.ndarray) -> np.ndarray:
    """The symbol before each row; the first position follows the last one, a separator."""
    if not len(text):
        return np.zeros(0, np.int32)
    rank, width = text.astype(np.int64), 1
    while width < DEPTH:
        # Ranks by twice as many symbols; past the end there are only separators.
        behind = np.zeros(len(rank), np.int64)
        behind[:-width] = rank[width:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    return text[order - 1].astype(np.int32)


def _steps(column: np.ndarray) -> np.ndarray:
    """Row of the position before each row's (last-to-first mapping)."""
    step = np.empty(len(column), np.int64)
    step[np.argsort(column, kind="stable")] = np.arange(len(column))
    return step


class FmIndex:
    """Both last columns of one text."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.forward, self.backward = forward, backward
        self._step, self._step_back = _steps(forward), _steps(backward)

    @classmethod
    def of(cls, text: np.ndarray) -> FmIndex:
        if len(text) and text[-1]:
            raise ValueError("a text ends with a separator")
        # The reversed text starts with its separator, which is moved to its end.
        return cls(last_column(text), last_column(np.roll(text[::-1], -1)))

    def words(self) -> Intervals:
        """The intervals of single symbols: phrase i is symbol i + 1."""
        n = np.bincount(self.forward)
        low = (np.cumsum(n) - n)[1:]
        return Intervals(low, low, n[1:])

    @staticmethod
    def _extended(column, step, low, n, other):
        """Every phrase with every symbol that stands before it: (phrase, interval here, in the other column, count)."""
        phrase = np.repeat(np.arange(len(low)), n)
        row = np.arange(len(phrase)) + np.repeat(low - (np.cumsum(n) - n), n)
        symbol = column[row].astype(np.int64)
        size = int(column.max(initial=0)) + 1
        key, first, count = np.unique(phrase * size + symbol, return_index=True, return_counts=True)
        phrase, symbol = key // size, key % size
        # In the other column the phrases follow each other by the new symbol.
        ahead = np.cumsum(count) - count
        opens = np.searchsorted(phrase, np.arange(len(low)))
        within = ahead - ahead[opens[phrase]]
        real = symbol > 0
        return (phrase[real], step[row[first]][real], (other[phrase] + within)[real], count[real])

    def grow(self, phrases: Intervals) -> Grown:
        """Phrases one word longer whose beginning and end are both among ``phrases``.

        Words are added in front of all and behind all; a longer phrase that both
        find has one interval.
        """
        end, low, back, n = self._extended(self.forward, self._step, phrases.low, phrases.n, phrases.back)
        begin, _, low_behind, _ = self._extended(self.backward, self._step_back, phrases.back, phrases.n, phrases.low)
        _, here, there = np.intersect1d(low, low_behind, assume_unique=True, return_indices=True)
        return Grown(Intervals(low[here], back[here], n[here]), begin[there], end[here])
