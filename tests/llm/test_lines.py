"""Line dedup against plain counting; taking documents back; the filters."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridclim.llm import lines
from gridclim.llm.lines import (
    CuckooFilter, LineRules, as_pairs, build_state, dedup_lines, insert_documents, remove_documents,
)

from .corpus import odd_rows, table

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(BLANKS).encode().lower().decode()


def expected(rows, least=5):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= 40:
                holders.setdefault(key_of(line), set()).add(doc_id)
    result = {}
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [
            line for line in own
            if doc_id is None or len(holders.get(key_of(line), ())) < least
            or max(holders[key_of(line)]) == doc_id
        ]
        result[doc_id, text] = (len(own), len(own) - len(kept), "\n".join(kept))
    return result


def shared_lines(seed=2):
    rng = random.Random(seed)
    pool = [f"line number {n} " + "é" * rng.randrange(15, 35) for n in range(30)]
    return odd_rows() + [
        (200 + n, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(4)))
        for n in range(60)
    ]


def check(rows, result):
    assert len(result) == len(rows)
    wanted = expected(rows)
    for row in result:
        options = [v for (doc_id, _), v in wanted.items() if doc_id == row.doc_id]
        assert (row.line_n_lines, row.line_n_dropped, row.text) in options, row.doc_id


@pytest.mark.parametrize("shared", [0, 1 << 40])
def test_lines_go_but_for_the_last_document(spark, monkeypatch, shared):
    """Alike with filters handed to all tasks and with lines brought to their filter."""
    monkeypatch.setattr(lines, "SHARED_FILTER_BYTES", shared)
    monkeypatch.setattr(lines, "SHARD_KEYS", 7)
    rows = shared_lines()
    docs = table(spark, rows)
    result = dedup_lines(docs)
    assert result.columns[:-2] == docs.columns
    check(rows, result.collect())


def contents(state):
    return [
        sorted(map(tuple, state.references.collect())), sorted(map(tuple, state.counts.collect())),
    ]


def passes(state):
    """Keys at the threshold must pass their filter."""
    made = {r.shard: CuckooFilter.from_bytes(bytes(r.slots)) for r in state.filters.collect()}
    for row in state.counts.collect():
        pair = as_pairs([bytes(row.key)])
        assert made[int(lines.shard_of(pair, state.shards)[0])].contains(pair)[0]
    return sum(int((f.table > 0).sum()) for f in made.values())


def test_documents_can_be_taken_back(spark):
    rows = [(i, t) for i, t in shared_lines() if i is not None]
    docs = table(spark, rows)
    late = F.col("doc_id") >= 215
    early = build_state(docs.where(~late))
    both = insert_documents(early, docs.where(late))
    whole = build_state(docs)
    assert contents(both) == contents(whole)
    assert passes(both) == both.counts.count() > early.counts.count()
    back = remove_documents(both, docs.where(late).select("doc_id"))
    assert contents(back) == contents(early)
    assert passes(back) == early.counts.count()


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(n).encode(), digest_size=16).digest() for n in range(6000)]
    made = CuckooFilter.of(keys[:3000])
    assert made.contains(as_pairs(keys[:3000])).all()
    assert made.contains(as_pairs(keys[3000:])).mean() < 0.01
    again = CuckooFilter.from_bytes(made.to_bytes())
    for key in keys[:1500]:
        assert again.remove(key)
    assert again.contains(as_pairs(keys[1500:3000])).all()
    assert again.contains(as_pairs(keys[:1500])).mean() < 0.01
    assert not CuckooFilter.of([]).contains(as_pairs(keys[:5])).any()


def test_empty_table(spark):
    assert dedup_lines(table(spark, [])).count() == 0
    assert LineRules().least_docs == 5
