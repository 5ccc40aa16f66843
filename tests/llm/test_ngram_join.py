"""The n-gram join against all pairs of a small table."""

import itertools
import random

import numpy as np
import pytest

from gridclim.llm import ngram_join
from gridclim.llm.ngram_join import BANDS, hamming, ngram_components, one_of_each_group

from .corpus import by_id, edited, odd_rows, table, words


def shingles(text):
    tokens = (text or "").encode().lower().split()
    if len(tokens) < 5:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}


def expected(rows):
    sets = {doc_id: shingles(text) for doc_id, text in rows if doc_id is not None}
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {doc_id: (len(own), find(doc_id)) for doc_id, own in sets.items()}


def check(spark, rows):
    result = ngram_components(table(spark, rows)).collect()
    assert len(result) == len(rows)
    wanted = expected(rows)
    for row in result:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert (row.n_shingles, row.component_id) == wanted[row.doc_id], row


def test_odd_rows(spark):
    check(spark, odd_rows())


def test_chains_and_borders(spark):
    """Sets of all small sizes, some just similar enough and some not; a crowd of near copies of
    which many are linked through others only; a passage that unlike documents share."""
    rng = random.Random(4)
    rows, doc_id = [], 0
    for n in [5, 6, 7, 8, 9, 10, 12, 13, 15, 18, 22, 27, 40, 60]:
        base = words(rng, n + 4)
        for k in range(6):
            rows.append((doc_id, " ".join(base[: len(base) - k] + words(rng, k % 3))))
            doc_id += 1
    crowd = words(rng, 150)
    for _ in range(60):
        crowd_member = edited(rng, crowd, rng.randrange(5))
        rows.append((doc_id, " ".join(crowd_member)))
        doc_id += 1
    passage = words(rng, 60)
    for _ in range(40):
        rows.append((doc_id, " ".join(words(rng, 90) + passage + words(rng, 90))))
        doc_id += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_bands_cover_all_sizes():
    for low, high in itertools.pairwise(BANDS[:20]):
        assert low.high == high.low and low.blocks > low.differing


def test_hamming_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for size in (64, 256):
        bits = rng.integers(0, 2, size), rng.integers(0, 2, size)
        packed = [np.packbits(b.astype(np.uint8)).tobytes() for b in bits]
        assert hamming(*packed) == int((bits[0] ^ bits[1]).sum())
    assert hamming(b"\x0f" * 8, b"\xf0" * 8) == 64
    # The longer one folds to nothing.
    assert hamming(b"\x0f" * 16, b"\x0f" * 8) == 32


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(None, "a b c d e f")]])
def test_nothing_to_link(spark, rows):
    check(spark, rows)


def test_one_of_each_group_stays(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    left = one_of_each_group(docs)
    assert left.columns == docs.columns
    wanted = expected(rows)
    kept = [r.doc_id for r in left.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(
        doc_id for doc_id, _ in rows if doc_id is not None and wanted[doc_id][1] == doc_id
    )
    assert by_id([(1, 2)]) == {1: (1, 2)}


def test_full_blocks_are_split_by_component(spark, monkeypatch):
    """Blocks of many members: near copies of which one component fills a task and others do not."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 30)
    rng = random.Random(7)
    rows, shared = [], words(rng, 90)
    for group, members in enumerate((40, 25, 6, 5, 1, 1)):
        base = shared + words(rng, 30)
        for _ in range(members):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(4)))))
    rows += [(len(rows) + n, rows[0][1]) for n in range(30)]
    rng.shuffle(rows)
    check(spark, rows)


def test_splits_of_a_block(spark, monkeypatch):
    """Each two members of different components meet once; those of one that fills a task do not."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    label = {n: 0 if n < 20 else 100 if n < 31 else n for n in range(36)}
    rows = [(5, n, own, len(label)) for n, own in label.items()]
    wide = spark.createDataFrame(rows, "token long, node long, label long, members long")
    met, tasks = {}, {}
    for row in ngram_join.split_blocks(wide).collect():
        tasks.setdefault((row.i, row.j), []).append(row)
    for (i, j), members in tasks.items():
        left = [m for m in members if m.own == i]
        right = [m for m in members if m.own == j]
        pairs = itertools.combinations(left, 2) if i == j else itertools.product(left, right)
        for a, b in pairs:
            pair = tuple(sorted((a.node, b.node)))
            met[pair] = met.get(pair, 0) + 1
    apart = {p for p in itertools.combinations(range(36), 2) if label[p[0]] != label[p[1]]}
    assert apart <= set(met) and set(met.values()) == {1}
    assert not any(label[a] == label[b] for a, b in met)


def test_tokens_of_a_run_are_summed():
    found = (
        np.array([7, 3, 7, 9, 7], np.uint64), np.array([4, 5, 2, 6, 8]),
        np.array([11, 12, 13, 14, 15]),
    )
    assert np.transpose(ngram_join.summed(*found)).tolist() == [
        [3, 5, 0, 12], [7, 2, 8, -3], [9, 6, 0, 14],
    ]
    assert np.transpose(ngram_join.members(*found)).tolist() == [[7, 4, 11], [7, 2, 13], [7, 8, 15]]
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    assert [len(c) for c in ngram_join.summed(*nothing) + ngram_join.members(*nothing)] == [0] * 7
