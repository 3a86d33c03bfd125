"""Words of whole texts, found and hashed for many texts in one numpy pass.

A word is a run of digits, a-z after lower-casing A-Z, or any character beyond ASCII:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. As no byte of a multi-byte UTF-8 character is
below 0x80, the same rule holds for bytes.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from relspark.llm.common import mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes, and words, that one numpy pass looks at.
STEP = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """doc: which text, ascending. hash: uint64 of the lower-cased word. first: for each text, the
    index of its first word; n + 1 entries. start: byte offsets in the whole buffer, if asked for."""

    def __init__(self, hash: np.ndarray, first: np.ndarray, start: np.ndarray | None = None):
        self.hash, self.first, self.start = hash, first, start

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, starts: bool = False, step: int = STEP) -> Words:
    """The words of all texts. The buffer is looked at `step` bytes at a time, so beside the result
    no more is held than that needs, however long a text is. A longer word is a step of its own."""
    n = len(data)
    hashes: list[np.ndarray] = []
    places: list[np.ndarray] = []
    first = np.zeros(len(offsets), np.int64)
    lo, total, size = 0, 0, step
    while lo < n:
        hi = min(n, lo + size)
        low = LOWER[data[lo:hi]]
        inside = IS_WORD[low]
        heads = np.empty(hi - lo, bool)
        heads[0], heads[1:] = True, inside[:-1] == 0
        a, b = np.searchsorted(offsets, (lo, hi))
        heads[offsets[a:b] - lo] = True  # a text begins: its first word may follow the last of another
        start = np.flatnonzero(inside & heads)
        tails = np.empty(hi - lo, bool)
        tails[-1], tails[:-1] = True, ~inside[1:] | heads[1:]
        end = np.flatnonzero(inside & tails) + 1
        ahead = hi
        if hi < n and len(end) and end[-1] == hi - lo and IS_WORD[LOWER[data[hi]]] and not (b < len(offsets) and offsets[b] == hi):
            if start[-1] == 0:  # the word is longer than the step
                size *= 2
                continue
            ahead, start, end = lo + int(start[-1]), start[:-1], end[:-1]
        size = step
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(BASE, hi - lo), out=sums[1:])
        code = (sums[end] - sums[start]) * powers(INVERSE, hi - lo)[start]
        hashes.append(mix64(code + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        a, b = np.searchsorted(offsets, (lo, ahead))
        first[a:b] = total + np.searchsorted(start, offsets[a:b] - lo)
        if starts:
            places.append(start + lo)
        total, lo = total + len(start), ahead
    first[np.searchsorted(offsets, n) :] = total
    join = lambda parts, kind: parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, kind)
    return Words(join(hashes, np.uint64), first, join(places, np.int64) if starts else None)


def hash_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)])).hash


def grams(found: Words, n: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place, and the places where n words of one text stand."""
    total = len(found.hash)
    left = np.diff(found.first)
    some = np.maximum(left - n + 1, 0)
    if total < n or not some.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(some.sum())
    place += np.repeat(found.first[:-1] - (np.cumsum(some) - some), some)
    code = np.zeros(len(place), np.uint64)
    for lo in range(0, len(place), step):
        at, part = place[lo : lo + step], code[lo : lo + step]
        for k in range(n):
            part[:] = mix64(part * np.uint64(BASE) + found.hash[at + k])
    return code, place
