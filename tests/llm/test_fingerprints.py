"""Fingerprints against a plain count of triplets, and their order along the documents."""

import hashlib
import math
import random

import pytest

from gridclim.llm import fingerprints as fp
from gridclim.llm.fingerprints import Digests, compared_with_next, fingerprints, likeness
from gridclim.llm.queries import op13_fingerprints

from .corpus import by_id, odd_rows, table

SF_DIR = "/root/testdata/sf0.001"


def plain_digest(text):
    """One triplet after the other, and codes from the sorted counts."""
    data, counts = text.encode() + bytes(3), [0] * 256
    for at in range(len(data) - 3):
        for kind, (second, third) in enumerate(((1, 2), (1, 3), (2, 3)), 1):
            value = data[at] | data[at + second] << 8 | data[at + third] << 16 | kind << 24
            value = value * 0x9E3779B1 & 0xFFFFFFFF
            value = (value ^ value >> 15) * 0x85EBCA77 & 0xFFFFFFFF
            counts[value >> 24] += 1
    cuts = [sorted(counts)[n] for n in (63, 127, 191)]
    codes = [sum(count > cut for cut in cuts) for count in counts]
    digits = "".join(
        f"{codes[n] << 6 | codes[n + 1] << 4 | codes[n + 2] << 2 | codes[n + 3]:02x}"
        for n in range(0, 256, 4)
    )
    return f"{min(255, int(math.log1p(len(text.encode())) / math.log(1.1))):02x}{digits}"


def plain_likeness(one, other):
    def codes(digest):
        return [int(c, 16) >> s & 3 for c in digest[2:] for s in (2, 0)]

    apart = sum((0, 1, 2, 6)[abs(a - b)] for a, b in zip(codes(one), codes(other)))
    return 1 - min(416, apart + abs(int(one[:2], 16) - int(other[:2], 16))) / 416


def plain_result(doc_id, text, following):
    third = len(text) // 3
    changed = text[: len(text) - third] + following[:third]
    own, other, after = map(plain_digest, (text, changed, following))
    return (
        doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other,
        plain_likeness(own, other), plain_likeness(own, after),
    )


def test_digests(spark):
    rows = [(i, t) for i, t in odd_rows() if t is None or len(t) < 20_000]
    found = fingerprints(table(spark, rows)).collect()
    wanted = [(i, len(t or ""), plain_digest(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert fingerprints(table(spark, [])).count() == 0


@pytest.mark.parametrize("group_bytes", [fp.GROUP_BYTES, 3000])
def test_chain_of_documents(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(fp, "GROUP_BYTES", group_bytes)
    rows = dict((i, t or "") for i, t in odd_rows() if i is not None and len(t or "") < 20_000)
    order = sorted(rows, reverse=True)
    wanted = [
        plain_result(i, rows[i], rows[j]) for i, j in zip(order, order[1:] + order[:1])
    ]
    docs = table(spark, list(rows.items()))
    for parts in (1, 7):
        found = compared_with_next(docs.repartition(parts)).collect()
        assert sorted(map(tuple, found)) == sorted(wanted)


def test_nulls_repeats_and_single_rows(spark):
    long = "word " * 100_000
    rows = [(3, "abc"), (3, "abc"), (None, None), (2, None), (None, "x"), (5, long), (5, "other")]
    found = [tuple(r) for r in compared_with_next(table(spark, rows)).collect()]
    texts = {3: {"abc"}, 2: {""}, None: {"", "x"}, 5: {long, "other"}}
    ids = [5, 5, 3, 3, 2, None, None]
    assert sorted(r[0] or 0 for r in found) == sorted(i or 0 for i in ids)
    for row in found:
        at = [n for n, i in enumerate(ids) if i == row[0]]
        after = {t for n in at for t in texts[ids[(n + 1) % len(ids)]]} | texts[row[0]]
        assert row in [plain_result(row[0], t, u) for t in texts[row[0]] for u in after]
    # Both rows of 3: one is followed by its copy, one by the empty text.
    assert sorted(r[-1] for r in found if r[0] == 3)[1] == 1.0
    [only] = compared_with_next(table(spark, [(1, "é" * 10)])).collect()
    assert tuple(only) == plain_result(1, "é" * 10, "é" * 10)
    assert compared_with_next(table(spark, [])).count() == 0


def test_likeness_is_bounded_and_falls_with_edits():
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyz") for _ in range(600)]
    text, last = " ".join(words), 1.0
    own = plain_digest(text)
    assert likeness(own, own) == 1.0
    for share in (0.02, 0.3, 1.0):
        changed = [w if rng.random() > share else "".join(rng.sample("mnopqrst", 4)) for w in words]
        value = likeness(own, plain_digest(" ".join(changed)))
        assert 0 <= value < last
        last = value
    assert Digests.read([own]).written() == [own]


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = {i: t or "" for i, t in docs}
    order = sorted(rows, reverse=True)
    found = by_id([tuple(r) for r in op13_fingerprints(spark, SF_DIR).collect()])
    assert found == {
        i: plain_result(i, rows[i], rows[j]) for i, j in zip(order, order[1:] + order[:1])
    }
    nearer = [row[5] > row[6] for row in found.values() if row[1] >= 100 and row[6] < 1]
    assert sum(nearer) >= 0.99 * len(nearer)
