"""Near duplicates of embeddings by collision counting.

Vectors of unit length are projected on many random lines. For a pair of cosine 0.98 the two
projections on a line lie a normal deviate of spread 0.2 apart, so they collide - fall into a window
centred at one of them - on nearly all lines, while other pairs collide on few. Lines come in
groups of three: two cut the plane into cells, which deal the vectors to tasks, and the third is
sorted; the windows around a query in it hold the pairs whose collisions are counted on all lines.
Pairs with enough collisions are verified by their cosine in double precision."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .tables import in_files, stored

FOUND = "node long, links long, other long"
#: Home rows, and query rows, of a cell that are compared in one task; of a fuller cell every part
#: of the home rows meets every part of the queries in a task of its own.
CELL_ROWS = 2000
#: Query rows whose windows are enumerated, verified and counted at a time.
QUERY_ROWS = 500


@dataclass(frozen=True)
class Projections:
    """``window`` is half the width of a window in spreads of a pair at the threshold; ``lost`` is
    the share of such pairs that the count may lose; ``missed`` of them are not met at all."""

    cosine: float = 0.98
    lines: int = 32
    groups: int = 4
    window: float = 2.5
    lost: float = 1e-6
    cell: float = 1.0
    seed: int = 11

    @property
    def half(self) -> float:
        return self.window * math.sqrt(2 - 2 * self.cosine)

    @property
    def collide(self) -> float:
        """How likely a pair at the threshold collides on a line."""
        return math.erf(self.window / math.sqrt(2))

    @property
    def least_count(self) -> int:
        """The largest count that loses no more than ``lost`` of the pairs at the threshold."""
        p, below = self.collide, 0.0
        for count in range(self.lines + 1):
            below += math.comb(self.lines, count) * p**count * (1 - p) ** (self.lines - count)
            if below > self.lost:
                return count
        return self.lines

    @property
    def missed(self) -> float:
        """The share of pairs at the threshold that collide on all three lines of no group."""
        return (1 - self.collide**3) ** self.groups

    def directions(self, size: int) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(size, self.lines))


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length one; None where it is null, empty, zero or not all finite numbers."""
    found = []
    for value in column:
        x = None
        if value.is_valid and value.values.null_count == 0 and len(value.values):
            x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            most = np.abs(x).max()
            if np.isfinite(most) and most > 0:
                x = x / most
                x = x / math.sqrt(float(x @ x))
            else:
                x = None
        found.append(x)
    return found


def cells_of(values: np.ndarray, p: Projections) -> Iterator[tuple[int, int, int, int]]:
    """(group, cell, cell, is_home) for a vector's home and for its queries: every cell that a
    window around it touches. Home counts as one of these, so it comes twice."""
    for group in range(p.groups):
        x, y = (float(v) for v in values[3 * group : 3 * group + 2])
        yield group, math.floor(x / p.cell), math.floor(y / p.cell), 1
        touched = [
            range(math.floor((v - p.half) / p.cell), math.floor((v + p.half) / p.cell) + 1)
            for v in (x, y)
        ]
        for a, b in itertools.product(*touched):
            yield group, a, b, 0


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id and node; equal vectors of a label share the node. Null where nothing can link."""
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.xxhash64("label", F.size("embedding"), "embedding")
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, key).alias("node"),
        "label", "embedding",
    )


PLACED = (
    "node long, copies long, label string, grp int, cell_x int, cell_y int, home int,"
    " vector binary, lines binary"
)


def placed(nodes: DataFrame, p: Projections) -> DataFrame:
    """Each usable vector in its home cells and query cells, with its projections."""
    names = [field.split()[0] for field in PLACED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string()] + [pa.int32()] * 4 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                rows = []
                for n, x in enumerate(unit_vectors(part.column("embedding"))):
                    if x is None:
                        continue
                    if len(x) not in directions:
                        directions[len(x)] = p.directions(len(x))
                    # Single precision, kept, so that all tasks see the same values.
                    lines = (x @ directions[len(x)]).astype("<f4")
                    node, copies, label = (
                        part.column(c)[n].as_py() for c in ("node", "copies", "label")
                    )
                    own = (node, copies, f"{label} {len(x)}")
                    for place in cells_of(lines, p):
                        rows.append((*own, *place, x.astype("<f8").tobytes(), lines.tobytes()))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names
                )

    return nodes.mapInArrow(run, PLACED)


def collisions(
    group: int, home: dict, query: dict, p: Projections
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, home) of the pairs of one cell that pass the count, some queries at a time. A pair is
    met from its larger node, and only in the first group of lines in which it collides, so it is
    counted once."""
    third = 3 * group + 2
    order = np.argsort(home["lines"][:, third], kind="stable")
    sorted_line = home["lines"][order, third]
    for low in range(0, len(query["node"]), QUERY_ROWS):
        lines = query["lines"][low : low + QUERY_ROWS]
        first = np.searchsorted(sorted_line, lines[:, third] - p.half, side="left")
        last = np.searchsorted(sorted_line, lines[:, third] + p.half, side="right")
        n = np.maximum(last - first, 0)
        q = np.repeat(np.arange(len(lines)), n)
        h = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)]
        keep = query["node"][low : low + QUERY_ROWS][q] > home["node"][h]
        q, h = q[keep], h[keep]
        for line in (3 * group, 3 * group + 1, 3 * group + 2):
            near = np.abs(lines[q, line] - home["lines"][h, line]) <= p.half
            q, h = q[near], h[near]
        # Line by line, so that a crowd of pairs takes no table of pairs and lines.
        hits = np.zeros(len(q), np.int64)
        enough = np.ones(len(q), bool)
        for lowest in range(0, p.lines, 3):
            together = np.ones(len(q), bool)
            for line in range(lowest, min(lowest + 3, p.lines)):
                hit = np.abs(lines[q, line] - home["lines"][h, line]) <= p.half
                hits += hit
                together &= hit
            if lowest < 3 * group:
                enough &= ~together
        enough &= hits >= p.least_count
        yield q[enough] + low, h[enough]


def side(table: pa.Table) -> dict:
    return {
        "node": table.column("node").to_numpy(),
        "copies": table.column("copies").to_numpy(),
        "vector": np.frombuffer(
            b"".join(table.column("vector").to_pylist()), "<f8"
        ).reshape(len(table), -1),
        "lines": np.frombuffer(
            b"".join(table.column("lines").to_pylist()), "<f4"
        ).reshape(len(table), -1),
    }


def joined_by(
    node: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The forest (node, least) with the links a - b added. One link of each end joins nearly all
    of a crowd; only links that still join something are then taken one by one."""
    if not len(a):
        return node, least
    few = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
    node, least = forest(np.concatenate([node, a[few]]), np.concatenate([least, b[few]]))

    def root(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(node, x), len(node) - 1)
        return np.where(node[at] == x, least[at], x)

    apart = root(a) != root(b)
    return forest(np.concatenate([node, a[apart]]), np.concatenate([least, b[apart]]))


def linked_in_cell(table: pa.Table, p: Projections) -> pa.Table:
    """Of one cell: how many vectors each node is linked with, and links that join its components.
    Links are counted here and not passed on, so a crowd of near copies stays a few rows."""
    is_home = pa.compute.equal(table.column("home"), 1)
    home, query = side(table.filter(is_home)), side(table.filter(pa.compute.invert(is_home)))
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    if not len(home["node"]) or not len(query["node"]):
        return schema.empty_table()
    links_q = np.zeros(len(query["node"]), np.int64)
    links_h = np.zeros(len(home["node"]), np.int64)
    node, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for q, h in collisions(table.column("grp")[0].as_py(), home, query, p):
        sure = np.zeros(len(q), bool)
        for low in range(0, len(q), 100_000):
            part = slice(low, low + 100_000)
            dots = np.einsum("ij,ij->i", query["vector"][q[part]], home["vector"][h[part]])
            sure[part] = dots >= p.cosine
        q, h = q[sure], h[sure]
        links_q += np.bincount(q, home["copies"][h], len(links_q)).astype(np.int64)
        links_h += np.bincount(h, query["copies"][q], len(links_h)).astype(np.int64)
        # What is known of the components so far is a forest, no longer than the rows.
        node, least = joined_by(node, least, query["node"][q], home["node"][h])
    counted = pa.table({
        "node": np.concatenate([query["node"], home["node"]]),
        "links": np.concatenate([links_q, links_h]),
        "other": pa.nulls(len(links_q) + len(links_h), pa.int64()),
    }, schema=schema)
    joined = pa.table({
        "node": node, "links": np.zeros(len(node), np.int64), "other": least
    }, schema=schema)
    return pa.concat_tables([counted.filter(pa.compute.greater(counted["links"], 0)), joined])


def embedding_components(vectors: DataFrame, p: Projections = Projections()) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label).

    Rows are linked when their labels are equal and the cosine of their vectors is at least 0.98.
    A vector that is null, empty, zero or holds a null or non-finite component, and a row without
    label or vec_id, is linked with nothing: n_links 0, a component of its own, kept. Vectors of
    different lengths are not linked. Repeated rows are equal vectors and linked with each other.
    component_id is the smallest vec_id of the component, null without vec_id. An empty table gives
    an empty one. Equal vectors are compared once, whatever their number."""
    rows = stored(classes(vectors), "vector-rows")
    n = rows.count()
    usable = rows.where(F.col("node").isNotNull())
    nodes = usable.groupBy("node").agg(
        F.count("*").alias("copies"), F.first("label").cast("string").alias("label"),
        F.first("embedding").alias("embedding"),
    )
    spots = stored(placed(nodes, p), "vector-cells", 100 * n)
    cell = ["label", "grp", "cell_x", "cell_y"]
    parts = spots.groupBy(*cell).agg(*[
        F.ceil(F.count(F.when(F.col("home") == which, 1)) / CELL_ROWS).cast("int").alias(name)
        for which, name in ((1, "home_parts"), (0, "query_parts"))
    ]).where("home_parts > 0")
    # A home row goes to its part and meets each part of the queries, a query the other way round.
    own = F.when(F.col("home") == 1, F.col("home_parts")).otherwise(F.col("query_parts"))
    other = F.when(F.col("home") == 1, F.col("query_parts")).otherwise(F.col("home_parts"))
    dealt = (
        spots.join(parts, cell).where(other > 0)
        .withColumn("own", F.pmod(F.xxhash64("node"), own).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
        .withColumn("home_part", F.when(F.col("home") == 1, F.col("own")).otherwise(F.col("other")))
        .withColumn("query_part", F.when(F.col("home") == 1, F.col("other")).otherwise(F.col("own")))
        .drop("own", "other", "home_parts", "query_parts")
    )

    def run(table: pa.Table) -> pa.Table:
        return linked_in_cell(table, p)

    found = dealt.groupBy(*cell, "home_part", "query_part").applyInArrow(run, FOUND)
    found = stored(found, "vector-links", 100 * n)
    counts = found.groupBy("node").agg(F.sum("links").alias("found"))
    joined = components(found.where(F.col("other").isNotNull()).select("node", "other"))
    # A vector that cannot be used has its node, but no place in a cell.
    real = stored(spots.select("node", "copies").distinct(), "vector-nodes", n)
    member = (
        rows.select("vec_id", "node").join(real, "node", "left").join(counts, "node", "left")
        .join(joined, "node", "left")
    )
    label = F.when(F.col("copies").isNotNull(), F.coalesce("least", "node"))
    member = member.select("vec_id", "copies", "found", label.alias("component"))
    smallest = member.where(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("vec_id").alias("smallest")
    )
    out = member.join(smallest, "component", "left").select(
        "vec_id",
        (F.coalesce("found", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("smallest", "vec_id").alias("component_id"),
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return in_files(out.withColumn("kept", kept), 4 * n)
