"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Sorted by size, each goes to the least loaded shard, which a
heap yields. Scheduling is sequential, so only a bounded number of items meets in one place:
every group above a fixed fraction of all bytes is an item of its own; smaller groups are first
gathered, in parallel, into bundles of about that fraction."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import in_files, stored

SHARDS = 8
#: Groups under 1/ITEMS of all bytes are bundled: at most ITEMS groups are above it, and at most
#: 2 * ITEMS bundles come out. It also bounds how far the shards can lie apart.
ITEMS = 32768
#: Rows that get their slots in one piece.
SLOT_ROWS = 4096


def least_loaded(sizes: list[int], shards: int = SHARDS) -> list[int]:
    """Shard of each item; ``sizes`` fall. Ties go to the shard with the smallest number."""
    heap = [(0, shard) for shard in range(shards)]
    chosen = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        chosen.append(shard)
    return chosen


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Puts all rows into shards of nearly equal bytes (law ``bytes``).

    size is the length of the text in UTF-8 plus 1. A null text has no bytes and counts as an
    empty one, so null and empty texts form one group. Repeated rows are placed together, as their
    texts are equal. A null doc_id is kept. Ties of size follow the group's digest, so a repeated
    run places alike. An empty table gives an empty one. A group larger than a shard's share makes
    its shard as large as itself, since it may not be split."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    items = stored(bundled(groups, (total or 0) / ITEMS, n_rows), "shard-items", 4 * n_rows)
    shard_of = items.join(schedule(items, shards), "item").select("digest", "shard")
    return in_files(with_slots(rows.join(shard_of, "digest"), n_rows), 4 * n_rows)


def bundled(groups: DataFrame, least: float, n_rows: int) -> DataFrame:
    """(digest, bytes, item): large groups alone, small ones in bundles. Small groups are dealt by
    their digest to cells of about ITEMS / 8 bundles in all; a running sum cuts each cell."""
    cells = max(1, min(ITEMS // 8, n_rows // SLOT_ROWS))
    small = F.col("bytes") < least
    cell = F.pmod(F.xxhash64("digest"), F.lit(cells))
    running = Window.partitionBy("cell").orderBy(F.desc("bytes"), "digest")
    cut = F.floor((F.sum("bytes").over(running) - F.col("bytes")) / F.lit(max(least, 1.0)))
    alone = groups.where(~small).select("digest", "bytes", F.hex("digest").alias("item"))
    together = (
        groups.where(small)
        .withColumn("cell", cell)
        .withColumn("cut", cut)
        .select("digest", "bytes", F.concat_ws("-", "cell", "cut").alias("item"))
    )
    return alone.unionByName(together)


def schedule(items: DataFrame, shards: int) -> DataFrame:
    """(item, shard). What reaches the driver is at most ITEMS groups and 2 * ITEMS bundles."""
    spark = items.sparkSession
    sums = items.groupBy("item").agg(F.sum("bytes").alias("bytes")).toPandas()
    sums = sums.sort_values(["bytes", "item"], ascending=[False, True])
    placed = pd.DataFrame(
        {"item": sums["item"], "shard": least_loaded(sums["bytes"].tolist(), shards)}
    )
    return spark.createDataFrame(placed.astype({"shard": "int32"}), "item string, shard int")


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Numbers the rows of a shard from 0 without gaps and without sorting a whole shard: rows are
    dealt to pieces, numbered within a piece, and moved by what stands in the pieces before."""
    pieces = max(1, n_rows // SLOT_ROWS)
    # Rows alike in doc_id and text have the same place in the order; which is first is no matter.
    order = ["doc_id", "digest"]
    rows = rows.withColumn("piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    rows = stored(rows, "shard-placed", 4 * n_rows)
    before = Window.partitionBy("shard").orderBy("piece")
    starts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    starts = starts.select(
        "shard", "piece", (F.sum("n").over(before) - F.col("n")).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*order))
    return (
        rows.withColumn("within", within)
        .join(starts, ["shard", "piece"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("within") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
