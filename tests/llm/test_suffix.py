"""Passage removal against all 50-byte strings of a small table; the sorting."""

import random

import numpy as np
import pytest

from gridclim.llm import suffix
from gridclim.llm.suffix import BlindTrie, dedup_passages, sorted_suffixes

from .corpus import odd_rows, table, words


def expected(rows):
    """doc_id, text -> (bytes, removed, spans, kept)"""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - 49):
            if doc_id is not None:
                string = data[at : at + 50]
                first[string] = min(first.get(string, doc_id), doc_id)
    result = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 49):
            if doc_id is not None and first[data[at : at + 50]] < doc_id:
                gone[at : at + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        result[doc_id, text] = (len(data), int(gone.sum()), spans, kept)
    return result


def passages(seed=3):
    """Passages of about the least length, at the ends and in the middle, overlapping."""
    rng = random.Random(seed)
    shared = " ".join(words(rng, 80))
    rows = odd_rows()
    for n in range(80):
        start = rng.randrange(len(shared) - 80)
        piece = shared[start : start + rng.choice([48, 49, 50, 51, 60, 80])]
        before = " ".join(words(rng, rng.randrange(0, 25)))
        after = " ".join(words(rng, rng.randrange(0, 25)))
        rows.append((300 + n, before + piece + after + rng.choice(["", piece, "é"])))
    rows += [(400, shared), (299, shared[10:200] * 2), (401, shared + "ü"), (402, "z" * 49)]
    return rows


@pytest.mark.parametrize("gathered", [suffix.GATHERED, 3])
def test_repeated_strings_go(spark, monkeypatch, gathered):
    """Alike whether the contexts of an anchor are gathered or counted string by string."""
    monkeypatch.setattr(suffix, "GATHERED", gathered)
    monkeypatch.setattr(suffix, "BUCKET_CONTEXTS", 50)
    rows = passages()
    docs = table(spark, rows)
    result = dedup_passages(docs)
    assert result.columns[:-4] == docs.columns
    result = result.collect()
    assert len(result) == len(rows)
    wanted = expected(rows)
    for row in result:
        options = [v for (doc_id, _), v in wanted.items() if doc_id == row.doc_id]
        own = (
            row.suffix_n_bytes, row.suffix_n_removed, row.suffix_n_spans, bytes(row.suffix_kept)
        )
        assert own in options, row.doc_id
        assert row.text == bytes(row.suffix_kept).decode("utf-8", "ignore")


def test_segments_change_nothing(monkeypatch):
    rng = random.Random(8)
    data = np.frombuffer(" ".join(words(rng, 900)).encode(), np.uint8)
    starts = np.array([0, 10, 10, 700, len(data)])
    whole = suffix.anchors(data, starts)
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    for a, b in zip(whole, suffix.anchors(data, starts)):
        assert (a == b).all()


def test_anchors_follow_from_the_string_alone():
    rng = random.Random(9)
    string = "".join(rng.choice("abc") for _ in range(50))
    found = set()
    for _ in range(30):
        data = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        text = np.frombuffer((data + string).encode(), np.uint8)
        found.add(int(suffix.selected(text)[len(data)]) - len(data))
    assert len(found) == 1 and found.pop() in range(suffix.OFFSETS)


def test_blind_trie_orders_strings():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(10)) for _ in range(300)]
    leaves = list(BlindTrie(strings).leaves())
    assert [strings[leaf[0]] for leaf in leaves] == sorted(set(strings))
    assert all(len({strings[n] for n in leaf}) == 1 for leaf in leaves)
    assert sum(map(len, leaves)) == 300


def test_deep_and_shallow_order():
    rng = random.Random(7)
    heads = [bytes(rng.choice(b"xy") for _ in range(40)) for _ in range(5)]
    rows = [rng.choice(heads) + bytes(rng.choice(b"ab") for _ in range(10)) for _ in range(400)]
    order, new = sorted_suffixes(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 50))
    arranged = [rows[n] for n in order]
    assert arranged == sorted(rows)
    assert new.tolist() == [n == 0 or arranged[n] != arranged[n - 1] for n in range(len(rows))]


def test_empty_table(spark):
    assert dedup_passages(table(spark, [])).count() == 0
