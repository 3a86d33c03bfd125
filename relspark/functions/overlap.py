"""Shared phrases of two texts: own definition of the overlaps that definition scores count.

The longest sequence of words that both texts hold is taken first (ties: the earliest in the
first text, then in the second), and its words are used up in both; then the next, until none
is left. A sequence of stop words only does not count and is not taken.

Many pairs of texts are worked on together: the places where a word of one stands in the other lie
on diagonals, and a shared sequence is a run on one. Each round takes one run of every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Places of equal words that are held together; a pair with more of them is searched row by row.
CELLS = 1 << 21


def overlaps(a: list[str], b: list[str], stop: frozenset[str] = frozenset()) -> list[list[str]]:
    """The phrases of one pair, in memory linear in its words."""
    return [a[i : i + n] for i, n in places(a, b, stop)]


def places(a: list[str], b: list[str], stop: frozenset[str]) -> list[tuple[int, int]]:
    """Where the phrases of one pair begin in the first text, and their numbers of words."""
    a, b = list(a), list(b)
    out: list[tuple[int, int]] = []
    while True:
        best = (0, 0, 0)
        before = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            row = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x is not None and x == y:
                    n = row[j + 1] = before[j] + 1
                    start = (n, -(i - n + 1), -(j - n + 1))
                    if start > best and not all(w in stop for w in a[i - n + 1 : i + 1]):
                        best = start
            before = row
        n, i, j = best[0], -best[1], -best[2]
        if not n:
            return out
        out.append((i, n))
        # a used word matches nothing, and no sequence reaches across it
        a[i : i + n] = [None] * n
        b[j : j + n] = [object()] * n


def spread(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each of sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Cells:
    """Places (i, j) of equal words of many pairs, in the order of pairs, diagonals and i."""

    def __init__(self, pair: np.ndarray, i: np.ndarray, j: np.ndarray, plain: np.ndarray):
        order = np.lexsort((i, i - j, pair))
        self.pair, self.i, self.j, self.plain = pair[order], i[order], j[order], plain[order]

    def keep(self, mask: np.ndarray) -> None:
        self.pair, self.i, self.j, self.plain = self.pair[mask], self.i[mask], self.j[mask], self.plain[mask]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First cells, and lengths, of the longest sequences that are not of stop words only."""
        new = np.ones(len(self.i), bool)
        new[1:] = (self.pair[1:] != self.pair[:-1]) | (self.i[1:] != self.i[:-1] + 1) | (self.j[1:] != self.j[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(self.i)))
        counted = np.add.reduceat(self.plain.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
        return first[counted], length[counted]


def phrases_of(words_a: np.ndarray, ends_a: np.ndarray, words_b: np.ndarray, ends_b: np.ndarray, stopped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place in the first text, length) of all phrases of pairs of texts, whose words are numbers; stopped: by number. ends: n + 1 of each side."""
    n = len(ends_a) - 1
    pair_a, pair_b = np.repeat(np.arange(n), np.diff(ends_a)), np.repeat(np.arange(n), np.diff(ends_b))
    key_a, key_b = pair_a * len(stopped) + words_a, pair_b * len(stopped) + words_b
    order = np.argsort(key_b, kind="stable")
    low, high = (np.searchsorted(key_b[order], key_a, side=s) for s in ("left", "right"))
    at = np.repeat(np.arange(len(key_a)), high - low)
    to = order[spread(high - low) + np.repeat(low, high - low)]
    cells = Cells(pair_a[at], at - ends_a[pair_a[at]], to - ends_b[pair_a[at]], ~stopped[words_a[at]])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(cells.i):
        first, length = cells.runs()
        best = np.lexsort((cells.j[first], cells.i[first], -length, cells.pair[first]))
        best = best[np.unique(cells.pair[first][best], return_index=True)[1]]  # the first of each pair
        pair, i, j, size = cells.pair[first[best]], cells.i[first[best]], cells.j[first[best]], length[best]
        found.append((pair, i, size))
        # Words that are used up match nothing more; pairs without a phrase are done.
        own = np.searchsorted(pair, cells.pair)
        own = np.minimum(own, max(len(pair) - 1, 0))
        left = pair[own] == cells.pair if len(pair) else np.zeros(len(cells.i), bool)
        if len(pair):
            left &= ~((cells.i >= i[own]) & (cells.i < (i + size)[own])) & ~((cells.j >= j[own]) & (cells.j < (j + size)[own]))
        cells.keep(left)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def found_phrases(left: list[list[str]], right: list[list[str]], stop: frozenset[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, place in the first text, length) of the phrases of many pairs; those of a pair together, in the order in which they are taken."""
    number: dict[str, int] = {}
    code = lambda texts: np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(texts)), np.int64)
    a, b = code(left), code(right)
    stopped = np.fromiter((w in stop for w in number), bool, len(number))
    ends = [np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64) for texts in (left, right)]
    lo = 0
    bound = np.diff(ends[0]) * np.diff(ends[1])  # cells at most
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(bound[lo:]), CELLS, side="right")) + lo)
        if hi == lo + 1 and bound[lo] > CELLS:
            words, counts = np.unique(a[ends[0][lo] : ends[0][hi]], return_counts=True)
            also, more = np.unique(b[ends[1][lo] : ends[1][hi]], return_counts=True)
            both, x, y = np.intersect1d(words, also, return_indices=True)
            if int((counts[x].astype(np.int64) * more[y]).sum()) > CELLS:
                at = np.array(places(left[lo], right[lo], stop), np.int64).reshape(-1, 2)
                yield np.full(len(at), lo), at[:, 0], at[:, 1]
                lo = hi
                continue
        pair, i, size = phrases_of(a[ends[0][lo] : ends[0][hi]], ends[0][lo : hi + 1] - ends[0][lo], b[ends[1][lo] : ends[1][hi]], ends[1][lo : hi + 1] - ends[1][lo], stopped)
        yield pair + lo, i, size
        lo = hi


def squared_phrases(left: list[list[str]], right: list[list[str]], stop: frozenset[str]) -> np.ndarray:
    """For each pair of texts the sum of the squared lengths of its phrases."""
    out = np.zeros(len(left))
    for pair, _, size in found_phrases(left, right, stop):
        out += np.bincount(pair, size.astype(float) ** 2, len(left))
    return out


def shared_phrases(a: Column, b: Column, stop: list[str] | None = None) -> Column:
    """What `overlap_score` is made of: the shared phrases, in the order in which they are taken, and both texts' numbers of words."""
    stopped = frozenset(stop or ())

    @F.pandas_udf("phrases array<string>, words_a int, words_b int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in parts:
            u, v = ([(t or "").split() for t in side] for side in (left, right))
            out: list[list[str]] = [[] for _ in u]
            for pair, i, size in found_phrases(u, v, stopped):
                for row, at, n in zip(pair.tolist(), i.tolist(), size.tolist()):
                    out[row].append(" ".join(u[row][at : at + n]))
            yield pd.DataFrame({"phrases": out, "words_a": [len(x) for x in u], "words_b": [len(x) for x in v]})

    return run(a, b)


def overlap_score(a: Column, b: Column, stop: list[str] | None = None, normalize: bool = False) -> Column:
    """Sum over shared phrases of their squared number of words; with normalize over the product
    of the texts' numbers of words. a, b: texts. A null or empty text scores 0."""
    stopped = frozenset(stop or ())

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            u, v = ([(t or "").split() for t in side] for side in (left, right))
            found = squared_phrases(u, v, stopped)
            if normalize:
                found = found / np.maximum([len(x) * len(y) for x, y in zip(u, v)], 1)
            yield pd.Series(found, dtype="float64")

    return run(a, b)
