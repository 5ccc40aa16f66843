"""Periodic runs of words: stretches that repeat a period four times or more.

Words are numbered, and the numbers of many texts lie behind each other with a number of its own
between them. At the scale B, a power of two, the text is cut into blocks of B words. For each block
the squared differences with all places B to 2 B - 1 words further on are summed by one convolution
(a number-theoretic transform, in whole numbers); a sum of zero is an occurrence. A run with a period
in this range holds at least two whole blocks that occur a period further on, so neighbouring blocks
with an equal distance seed it, and less than a block of words on each side is compared to extend it.

Blocks are left out only where no run can show: if a word of theirs does not come again within
2 B words, or if the block and its window lie in a run of a smaller period, found before."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import text_bytes

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed binary"
#: A run has so many words at least, and its period so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Primes of the transforms with a generator each: k * 2**e + 1, e at least 26.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Numbers that are transformed at once (one longer block may exceed it).
CELLS = 1 << 18
#: Bytes of texts that are searched together; one text is never cut.
GROUP_BYTES = 4_000_000


def reduced(values: np.ndarray, prime: int) -> np.ndarray:
    """Remainders of unsigned 64-bit numbers; a division by one number is faster than ``%``."""
    return values - values // np.uint64(prime) * np.uint64(prime)


def powers(base: int, count: int, prime: int) -> np.ndarray:
    """1, base, base**2, ... by doubling."""
    found = np.ones(1, np.uint64)
    while len(found) < count:
        found = np.concatenate([found, reduced(found * np.uint64(pow(base, len(found), prime)), prime)])
    return found[:count]


class Transform:
    """Number-theoretic transform of ``size`` numbers, a power of two, along the first axis. The
    transformed ones are in bit-reversed order, which a product of two transforms does not mind."""

    def __init__(self, size: int, prime: int, generator: int):
        self.size, self.prime = size, prime
        root = pow(generator, (prime - 1) // size, prime)
        self.roots = powers(root, max(1, size // 2), prime)
        self.inverse_roots = powers(pow(root, -1, prime), max(1, size // 2), prime)

    def forward(self, cells: np.ndarray) -> np.ndarray:
        prime, cells = np.uint64(self.prime), cells.copy()
        half, step = self.size // 2, 1
        while half:
            pairs = cells.reshape(step, 2, half, -1)
            left, right = pairs[:, 0], pairs[:, 1]
            total = left + right
            pairs[:, 1] = reduced((left + prime - right) * self.roots[::step][:half, None], self.prime)
            pairs[:, 0] = np.minimum(total, total - prime)  # below zero it wraps round
            half, step = half // 2, step * 2
        return cells

    def backward(self, cells: np.ndarray) -> np.ndarray:
        prime, cells = np.uint64(self.prime), cells.copy()
        half, step = 1, self.size // 2
        while step:
            pairs = cells.reshape(step, 2, half, -1)
            left = pairs[:, 0].copy()
            right = reduced(pairs[:, 1] * self.inverse_roots[::step][:half, None], self.prime)
            total, rest = left + right, left + prime - right
            pairs[:, 0] = np.minimum(total, total - prime)
            pairs[:, 1] = np.minimum(rest, rest - prime)
            half, step = half * 2, step // 2
        return reduced(cells * np.uint64(pow(self.size, -1, self.prime)), self.prime)


def squared_differences(block: np.ndarray, window: np.ndarray, transform: Transform) -> np.ndarray:
    """Per column: the sum of squared differences of the block and each stretch of the window, at
    0 to B - 1 words after its start, modulo the transform's prime. The window has 2 B words."""
    prime, width = transform.prime, len(block)
    turned = np.zeros_like(window)
    turned[0] = block[0]
    turned[width + 1 :] = block[:0:-1]
    product = reduced(transform.forward(turned) * transform.forward(window), prime)
    both = transform.backward(product)[:width]
    own = reduced(reduced(block * block, prime).sum(axis=0), prime)
    squares = np.zeros((len(window) + 1, window.shape[1]), np.uint64)
    np.cumsum(reduced(window * window, prime), axis=0, out=squares[1:])
    other = squares[width : 2 * width] - squares[:width]
    return reduced(own + other + np.uint64(2) * (np.uint64(prime) - both), prime)


def occurrences(cells: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks and the distances, ``width`` to 2 ``width`` - 1, at which they occur again.

    A sum of squares is below ``width`` times the largest square; it is zero if it is zero modulo
    primes whose product is larger."""
    largest = int(cells.max()) ** 2 * width
    found_start, found_distance = [], []
    per_turn = max(1, CELLS // (2 * width))
    offsets = np.arange(3 * width)[:, None]
    transforms: list[Transform] = []
    for at in range(0, len(starts), per_turn):
        own = starts[at : at + per_turn]
        text = cells[own + offsets]
        columns, proven = np.arange(len(own)), 1
        zero = np.ones((width, len(own)), bool)
        for n, (prime, generator) in enumerate(PRIMES):
            if proven > largest or not len(columns):
                break
            if n == len(transforms):
                transforms.append(Transform(2 * width, prime, generator))
            sums = squared_differences(
                text[:width, columns], text[width:, columns], transforms[n]
            )
            zero[:, columns] &= sums == 0
            columns = columns[zero[:, columns].any(axis=0)]
            proven *= prime
        distance, column = np.nonzero(zero)
        found_start.append(own[column])
        found_distance.append(distance + width)
    if not found_start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_start), np.concatenate(found_distance)


def equal_words(cells: np.ndarray, first: np.ndarray, distance: np.ndarray, step: int, most: int):
    """How many words from ``first`` on, in direction ``step``, equal those ``distance`` further
    on; ``most`` at most."""
    counts = np.empty(len(first), np.int64)
    per_turn = max(1, CELLS // most)
    way = step * np.arange(most)
    for at in range(0, len(first), per_turn):
        turn = slice(at, at + per_turn)
        places = first[turn, None] + way
        inside = places >= 0
        places = np.maximum(places, 0)
        differ = ~(inside & (cells[places] == cells[places + distance[turn, None]]))
        counts[turn] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return counts


def seeded_runs(cells: np.ndarray, starts: np.ndarray, distances: np.ndarray, width: int):
    """Runs (start, end, period) from the occurrences of blocks."""
    order = np.lexsort((starts, distances))
    starts, distances = starts[order], distances[order]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (distances[1:] != distances[:-1]) | (starts[1:] != starts[:-1] + width)
    first = np.flatnonzero(fresh)
    blocks = np.diff(np.append(first, len(starts)))
    start, period = starts[first], distances[first]
    # So many whole blocks lie in the words of a run that come again in it.
    enough = blocks >= ((LEAST_TIMES - 1) * period - width + 1) // width
    start, period, blocks = start[enough], period[enough], blocks[enough]
    end = start + blocks * width
    left = equal_words(cells, start - 1, period, -1, width)
    right = equal_words(cells, end, period, 1, width)
    start, end = start - left, end + right + period
    # A whole further block can only be one left out, in a run of a smaller period.
    runs = (left < width) & (right < width)
    runs &= end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    return start[runs], end[runs], period[runs]


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of numbered words, by start, then period; ``longest`` is the
    length of the longest stretch between words that stand once."""
    count = len(words)
    found = [np.zeros(0, np.int64)] * 3
    reach = np.zeros(count + 1, np.int64)  # where the runs that start here or before end at most
    order = np.argsort(words, kind="stable")
    again = words[order[1:]] == words[order[:-1]]
    next_one = np.full(count, count + 1)
    next_one[order[:-1][again]] = (order[1:] - order[:-1])[again]
    width = 1
    while LEAST_TIMES * width <= longest:
        blocks = count // width
        near = (next_one[: blocks * width] < 2 * width).reshape(blocks, width).all(axis=1)
        starts = np.arange(blocks) * width
        near &= reach[:-1][starts] < starts + 3 * width
        beside = np.zeros(blocks, bool)
        beside[1:] = near[:-1]
        beside[:-1] |= near[1:]
        starts = starts[near & beside]
        if len(starts):
            # What stands behind the text equals none of its words.
            cells = np.append(words, np.full(3 * width, words.max() + 1)).astype(np.uint64)
            start, distance = occurrences(cells, starts, width)
            fresh = reach[start] < start + distance + width
            new = seeded_runs(cells, start[fresh], distance[fresh], width)
            found = [np.concatenate(pair) for pair in zip(found, new)]
            np.maximum.at(reach, new[0], new[1])
            reach = np.maximum.accumulate(reach)
        width *= 2
    order = np.lexsort((found[2], found[0]))
    start, end, period = (column[order] for column in found)
    return start, end, period


@dataclass(frozen=True)
class Runs:
    """Runs of one text as (start, length, period), and its words without the repetitions."""

    n_words: int
    runs: list[tuple[int, int, int]]
    collapsed: bytes

    @property
    def best(self) -> tuple[int, int, int] | None:
        """The run with the greatest length by period, compared as fractions; of equal ones the
        first, of those the one with the smallest period."""
        best = None
        for run in self.runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        return best


def runs_of_texts(texts: list[bytes]) -> list[Runs]:
    """The runs of each text. Words stand between blanks (0x20, 0x09 to 0x0D)."""
    split = [text.split() for text in texts]  # of bytes: at these blanks alone
    number: dict[bytes, int] = {}
    words = []
    for n, own in enumerate(split):
        words += [number.setdefault(word, len(number)) for word in own]
        words.append(-1 - n)
    cells = np.array(words, np.int64)
    apart = cells < 0
    cells[apart] = len(number) + np.arange(len(texts))
    ends = np.flatnonzero(apart)
    first = np.append(0, ends[:-1] + 1)
    starts, stops, periods = find_runs(cells, max(map(len, split), default=0))
    bounds = np.searchsorted(starts, np.append(first, len(cells)))
    found = []
    for n, own in enumerate(split):
        mine = slice(bounds[n], bounds[n + 1])
        start, period = starts[mine] - first[n], periods[mine]
        length = stops[mine] - starts[mine]
        if len(start):
            edges = np.zeros(len(own) + 1, np.int64)
            np.add.at(edges, start + period, 1)
            np.add.at(edges, start + length, -1)
            kept = np.cumsum(edges[:-1]) == 0
            left = [word for word, stays in zip(own, kept.tolist()) if stays]
        else:
            left = own
        runs = list(zip(start.tolist(), length.tolist(), period.tolist()))
        found.append(Runs(len(own), runs, b" ".join(left)))
    return found


def groups(sizes: list[int], most: int = GROUP_BYTES) -> Iterator[slice]:
    """Neighbours of ``most`` bytes together, about."""
    start = total = 0
    for at, size in enumerate(sizes):
        total += size
        if total >= most:
            yield slice(start, at + 1)
            start, total = at + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): its number of words,
    all runs by start, then period, the run with the greatest length by period, and the text
    without the repetitions, its words joined by one blank.

    A run is a stretch of words with smallest period q that no neighbouring word extends, of 6 and
    4 q words at least; of its words the first q stay, unless they repeat in another run. A null or
    empty text has no words, no runs, a null ``best`` and nothing left. A null doc_id stays null,
    repeated rows give repeated rows, an empty table an empty one. Texts are searched whole, some
    megabytes of them at a time; a longer one by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for part in groups(sizes):
                own = batch.slice(part.start, part.stop - part.start)
                found = runs_of_texts(own.column(1).to_pylist())
                span = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        pa.array([f.n_words for f in found], pa.int64()),
                        pa.array([[as_span(r) for r in f.runs] for f in found], pa.list_(span)),
                        pa.array([as_span(f.best) for f in found], span),
                        pa.array([f.collapsed for f in found], pa.binary()),
                    ],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, SCHEMA)


def as_span(run: tuple[int, int, int] | None) -> dict | None:
    return None if run is None else dict(zip(("start", "length", "period"), run))
