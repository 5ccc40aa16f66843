"""Embedding near duplicates against all pairs."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gridclim.llm import vectors
from gridclim.llm.vectors import Projections, embedding_components

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies long, part int"


def table(spark, rows):
    return spark.createDataFrame(
        [(i, None if x is None else [None if v is None else float(v) for v in x], label, 1, 2, 3)
         for i, x, label in rows], SCHEMA
    )


def expected(rows, cosine=0.98):
    usable = []
    for n, (vec_id, x, label) in enumerate(rows):
        if x is None or label is None or vec_id is None or any(v is None for v in x) or not len(x):
            continue
        x = np.array(x, np.float32).astype(float)
        if np.isfinite(x).all() and x.any():
            usable.append((n, vec_id, x / np.abs(x).max(), label))
    links = {n: set() for n in range(len(rows))}
    for n, _, x, label in usable:
        for m, _, y, other in usable:
            if n != m and label == other and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[n].add(m)
    result = []
    for n, (vec_id, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        kept = vec_id is None or component == vec_id
        result.append((vec_id, len(links[n]), component, kept))
    return sorted(result, key=repr)


def crowd(seed=1):
    """Clusters of near vectors around the threshold, in two labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for vec_id in range(400):
        if vec_id % 4:
            x = rng.normal(size=24)
        else:
            base = np.random.default_rng(100 + vec_id % 12).normal(size=24)
            x = base + rng.normal(size=24) * rng.choice([0.05, 0.1, 0.14, 0.2])
        rows.append((vec_id, x.astype(np.float32).tolist(), vec_id % 2))
    return rows


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [None] * 24, 1),
    (1004, [float("nan")] * 24, 1), (1005, [float("inf")] * 24, 1), (1006, [1.0] * 24, None),
    (1007, [1.0] * 24, None), (1008, [1.0] * 24, 1), (1009, [1.0] * 24, 1), (1009, [1.0] * 24, 1),
    (1010, [2.0] * 24, 1), (1011, [1.0] * 24, 0), (1012, [1.0] * 5, 1), (1013, [1.0] * 5, 1),
    (None, [1.0] * 24, 1), (1014, [3e38] * 24, 1), (1015, [1e-40] * 24, 1),
    (1016, [-1.0] * 24, 1),
]


@pytest.mark.parametrize("cell_rows", [vectors.CELL_ROWS, 9])
def test_all_links_are_found(spark, monkeypatch, cell_rows):
    """Alike with whole cells and with cells split among tasks."""
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    rows = crowd() + ODD
    result = embedding_components(table(spark, rows)).collect()
    assert sorted(map(tuple, result), key=repr) == expected(rows)
    assert max(r.n_links for r in result) > 10


def test_a_crowd_of_near_copies(spark):
    """Vectors of one label in one cell, none equal: every link is counted, in bounded parts."""
    rng = np.random.default_rng(9)
    base, n = rng.normal(size=16), 6000
    x = (base + 0.1 * rng.normal(size=(n, 16))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cosine = unit @ unit.T
    wanted = (cosine >= 0.98).sum(axis=1) - 1
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    found = {r.vec_id: r for r in embedding_components(table(spark, rows)).collect()}
    # A pair in some ten thousand may lie within rounding of the threshold or collide too rarely.
    got = np.array([found[i].n_links for i in range(n)])
    assert np.abs(got - wanted).sum() <= 2e-6 * wanted.sum() + 2 * (np.abs(cosine - 0.98) < 1e-12).sum()
    assert {r.component_id for r in found.values() if r.n_links} == {0}


def test_memory_of_a_crowded_part():
    """A full part of near copies, all of which pass: some hundred MB at most."""
    rng = np.random.default_rng(2)
    p, n = Projections(), vectors.CELL_ROWS
    x = rng.normal(size=64) + 0.01 * rng.normal(size=(2 * n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lines = (x @ p.directions(64)).astype("<f4")
    part = pa.table({
        "node": np.arange(2 * n), "copies": np.ones(2 * n, np.int64),
        "grp": pa.array([0] * 2 * n, pa.int32()),
        "home": pa.array([1] * n + [0] * n, pa.int32()),
        "vector": [v.astype("<f8").tobytes() for v in x], "lines": [v.tobytes() for v in lines],
    })
    tracemalloc.start()
    found = vectors.linked_in_cell(part, p).to_pandas()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.links.sum() == 2 * n * n
    assert most < 500e6


def test_recall_at_the_threshold():
    """Pairs of cosine 0.98 exactly: the count keeps them, and some group of lines meets them."""
    p, rng = Projections(), np.random.default_rng(5)
    lines = p.directions(64)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away
    hits = np.abs(x @ lines - y @ lines) <= p.half
    met = hits[:, : 3 * p.groups].reshape(-1, p.groups, 3).all(axis=2).any(axis=1)
    assert ((hits.sum(axis=1) >= p.least_count) & met).mean() > 0.999


def test_empty_table(spark):
    assert embedding_components(table(spark, [])).count() == 0


def test_chance_of_losing_a_pair_at_the_threshold():
    p = Projections()
    below = sum(
        math.comb(p.lines, k) * p.collide**k * (1 - p.collide) ** (p.lines - k)
        for k in range(p.least_count)
    )
    # The figures of the README.
    assert (f"{below:.1e}", f"{p.missed:.1e}") == ("1.2e-07", "1.8e-06")
