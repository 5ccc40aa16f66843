"""Periodic runs against a plain search for every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridclim.llm import runs
from gridclim.llm.queries import op11_periodic_runs
from gridclim.llm.runs import (
    PRIMES, Transform, find_runs, periodic_runs, runs_of_texts, squared_differences,
)

from .corpus import by_id, odd_rows, table

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) by start, then period: every period is tried at every word."""
    n, found, seen = len(words), [], set()
    for period in range(1, n // 4 + 1):
        at = 0
        while at + period < n:
            start = at
            while at + period < n and words[at] == words[at + period]:
                at += 1
            end = at + period
            # A stretch that a smaller period has already is not a run of this one.
            if end - start >= max(6, 4 * period) and (start, end) not in seen:
                seen.add((start, end))
                found.append((start, end - start, period))
            at += at == start
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    dropped = {i for start, length, q in found for i in range(start + q, start + length)}
    return b" ".join(word for i, word in enumerate(words) if i not in dropped)


def best_of(found):
    key = lambda run: (-Fraction(run[1], run[2]), run[0], run[2])
    return min(found, key=key, default=None)


def random_text(rng):
    words = []
    while rng.random() < 0.85 and len(words) < 400:
        period = rng.choice([1, 1, 2, 3, 4, 5, 8, 13, 20])
        letters = "abc" if rng.random() < 0.7 else "abcdefghijkl"
        root = [rng.choice(letters) for _ in range(period)]
        words += (root * rng.randrange(1, 12))[: rng.randrange(1, 12 * period)]
    return " ".join(words).encode()


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 6))]
        for text, found in zip(texts, runs_of_texts(texts)):
            words = text.split()
            assert found.runs == plain_runs(words)
            assert found.best == best_of(found.runs)
            assert found.collapsed == collapsed(words, found.runs)


def test_words_that_hold_all_shapes_of_repetition():
    first, second = ["a"], ["a", "b"]
    while len(second) < 1500:
        first, second = second, second + first
    turned = [bin(i).count("1") % 2 for i in range(2048)]  # holds nothing three times in a row
    shapes = [second, ["a"] * 997, (["a"] * 30 + ["c"]) * 40, ["a", "b"] * 300 + ["a"] * 500]
    shapes += [list(map(str, turned)), list(map(str, turned)) * 5]
    texts = [" ".join(map(str, words)).encode() for words in shapes]
    for text, found in zip(texts, runs_of_texts(texts)):
        assert found.runs == plain_runs(text.split())


def test_long_texts():
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(60_000)) + " "
    one, two, three = runs_of_texts([b"x " * 300_000, (long * 5).encode(), long.encode()])
    assert one.runs == [(0, 300_000, 1)] and one.collapsed == b"x"
    assert two.runs == [(0, 300_000, 60_000)] and two.collapsed.decode() == long.strip()
    assert three.runs == []


@pytest.mark.parametrize("width", [1, 2, 8, 64])
@pytest.mark.parametrize("prime", PRIMES)
def test_sums_of_squares(width, prime):
    rng = np.random.default_rng(width)
    block = rng.integers(0, 1 << 20, (width, 3)).astype(np.uint64)
    window = rng.integers(0, 1 << 20, (2 * width, 3)).astype(np.uint64)
    found = squared_differences(block, window, Transform(2 * width, *prime))
    for at in range(width):
        apart = block.astype(object) - window[at : at + width].astype(object)
        assert found[at].tolist() == ((apart * apart).sum(axis=0) % prime[0]).tolist()


def test_sums_beyond_one_prime(monkeypatch):
    """Squares that are a multiple of the first prime are no occurrence."""
    monkeypatch.setattr(runs, "PRIMES", ((17, 3), (97, 5)))
    words = np.array([0, 17, 0, 17, 0, 17, 3, 3, 3, 3, 3, 3, 3, 1, 2])
    assert [found.tolist() for found in find_runs(words, len(words))] == [[6], [13], [1]]


@pytest.mark.parametrize("group_bytes", [runs.GROUP_BYTES, 50])
def test_odd_rows(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(runs, "GROUP_BYTES", group_bytes)
    rows = odd_rows()
    found = periodic_runs(table(spark, rows)).collect()
    assert len(found) == len(rows)
    for row in found:
        texts = {(text or "").encode() for doc_id, text in rows if doc_id == row.doc_id}
        wanted = []
        for words in map(bytes.split, texts):
            own = plain_runs(words) if len(words) < 5000 else []
            wanted.append((len(words), own, best_of(own), collapsed(words, own)))
        spans = [tuple(run) for run in row.runs]
        best = tuple(row.best) if row.best else None
        assert (row.n_words, spans, best, bytes(row.collapsed)) in wanted
    assert periodic_runs(table(spark, [])).count() == 0


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = by_id([tuple(row) for row in op11_periodic_runs(spark, SF_DIR).collect()])
    assert len(found) == len(docs)
    for doc_id, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        own = plain_runs(words)
        best = best_of(own) or (None, None, None)
        lines = "".join(f"{start},{length},{period}\n" for start, length, period in own)
        assert found[doc_id] == (
            doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, own)).hexdigest(),
        )
