"""Hashes of word shingles, for a whole batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .tables import mix

WORDS = 5
#: Bytes whose words are hashed together, which bounds the arrays that this takes.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE * INVERSE is 1 modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: A-Z lowered; one more, so that no byte counts as nothing.
LOWERED = (np.arange(256) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0) + 1)
LOWERED = LOWERED.astype(np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    if n:
        factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class WordHasher:
    def __init__(self):
        self.up = powers(BASE, CHUNK)
        self.down = powers(INVERSE, CHUNK)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each word; text n has the bytes from starts[n] to starts[n + 1]."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        blank = BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        opens = ~blank
        opens[1:] &= blank[:-1] | edge[1:-1]
        begin = np.flatnonzero(opens)
        closes = ~blank
        closes[:-1] &= blank[1:] | edge[1:-1]
        end = np.flatnonzero(closes) + 1
        owner = np.searchsorted(starts, begin, side="right") - 1
        hashes = np.empty(len(begin), np.uint64)
        at = 0
        while at < len(begin):
            # Whole words of about CHUNK bytes.
            stop = max(at + 1, int(np.searchsorted(end, begin[at] + CHUNK, side="right")))
            low, high = int(begin[at]), int(end[stop - 1])
            self._grow(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(LOWERED[data[low:high]] * self.up[: high - low], out=sums[1:])
            first, last = begin[at:stop] - low, end[at:stop] - low
            hashes[at:stop] = (sums[last] - sums[first]) * self.down[first]
            at = stop
        return owner, mix(hashes)


def shingle_sets(hasher: WordHasher, data: np.ndarray, starts: np.ndarray):
    """(text, hash) of the distinct shingles of each text, in order of text and hash. A text of
    fewer words than a shingle has its whole sequence as one; without words it has none."""
    owner, words = hasher.words(data, starts)
    counts = np.bincount(owner, minlength=len(starts) - 1)
    value = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for j in range(WORDS):
        value = value * STEP + words[j : j + len(value)]
    whole = owner[: len(value)] == owner[WORDS - 1 :]
    texts, hashes = [owner[: len(value)][whole]], [value[whole]]
    first = np.cumsum(counts) - counts
    for text in np.flatnonzero((counts > 0) & (counts < WORDS)):
        sequence = np.uint64(counts[text])
        for word in words[first[text] : first[text] + counts[text]]:
            sequence = mix(np.array([sequence ^ word]))[0]
        texts.append(np.array([text]))
        hashes.append(np.array([sequence]))
    owner, value = np.concatenate(texts), mix(np.concatenate(hashes))
    order = np.lexsort([value, owner])
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def runs(starts: np.ndarray, most: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about ``most`` bytes; one text is never cut."""
    at, last = 0, len(starts) - 1
    while at < last:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        yield at, stop
        at = stop
