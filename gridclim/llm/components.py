"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for every node that some of these links join to a smaller one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    least = np.array([find(x) for x in range(len(nodes))], np.int64)
    joined = least != np.arange(len(nodes))
    return nodes[joined], nodes[least[joined]]


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: each batch becomes a forest of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, least = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["node", "least"])

    return links.mapInArrow(run, "node long, least long")


def _with_least(links: DataFrame) -> DataFrame:
    """Each node's links, either way, with the least node among itself and its neighbours. Minima
    are formed before rows move; adaptive execution splits the links of a node that has many."""
    turned = links.select(F.col("least").alias("node"), F.col("node").alias("least"))
    both = links.unionByName(turned)
    both = both.select(F.col("node").alias("u"), F.col("least").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, least) for every node of ``links`` (two long columns) that is not the least of its
    component. Alternates large and small stars until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Every round is a stored table."""
    first, second = links.columns
    links = links.select(F.col(first).alias("node"), F.col(second).alias("least"))
    links = links.where(F.col("node") != F.col("least"))
    current = stored(contracted(links).distinct(), "links", links.count())
    seen, n = None, current.count()
    while True:
        large = _with_least(current).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("node"), F.col("m").alias("least")).distinct()
        # Small star: the neighbours below a node, and the node itself, go to the least of them.
        least = large.groupBy("node").agg(F.min("least").alias("m"))
        small = large.join(least, "node")
        small = (
            small.select(F.col("least").alias("node"), F.col("m").alias("least"))
            .unionByName(least.select("node", F.col("m").alias("least")))
            .where(F.col("node") != F.col("least"))
            .distinct()
        )
        current = stored(small, "links", n)
        sign = current.agg(F.count("*"), F.sum(F.xxhash64("node", "least").cast("decimal(38,0)")))
        sign = tuple(sign.first())
        if sign == seen:
            return current
        seen, n = sign, sign[0]
