"""Sharding against a plain scheduling loop."""

import heapq
import zlib

from gridclim.llm import sharding
from gridclim.llm.sharding import least_loaded, shard_documents

from .corpus import odd_rows, table


def loads(rows):
    found = [0] * 8
    for row in rows:
        found[row.shard] += row.size
    return found


def check(rows, result):
    assert len(result) == len(rows)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, set()).add((text or "").encode())
    for row in result:
        own = {(len(t) + 1, zlib.crc32(t)) for t in texts[row.doc_id]}
        assert (row.size, row.text_crc32) in own
        assert row.law == "bytes" and row.grown_shard is None
    for shard in range(8):
        slots = sorted(r.slot for r in result if r.shard == shard)
        assert slots == list(range(len(slots)))
    place = {}
    for row in result:
        assert place.setdefault((row.size, row.text_crc32), row.shard) == row.shard


def test_groups_stay_together_and_loads_are_those_of_the_heap(spark):
    rows = odd_rows() + [(100 + n, "filler " * (n % 40)) for n in range(120)]
    result = shard_documents(table(spark, rows)).collect()
    check(rows, result)
    groups = {}
    for _, text in rows:
        groups[text or ""] = groups.get(text or "", 0) + len((text or "").encode()) + 1
    heap = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(loads(result)) == sorted(heap)


def test_ties_go_to_the_first_shard():
    assert least_loaded([5, 5, 5, 3], shards=3) == [0, 1, 2, 0]


def test_bundles_and_pieces(spark, monkeypatch):
    """With few items and small pieces, small groups are bundled and loads stay near equal."""
    monkeypatch.setattr(sharding, "ITEMS", 64)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rows = [(n, f"text {n} " * (1 + n % 9)) for n in range(1500)]
    rows += [(2000 + n, "hot text") for n in range(700)]
    result = shard_documents(table(spark, rows)).collect()
    check(rows, result)
    total = loads(result)
    assert max(total) - min(total) <= 2 * sum(total) / 64


def test_empty_table(spark):
    assert shard_documents(table(spark, [])).count() == 0
