"""What the operators share: reading tables, storing steps, Arrow columns as numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a file of a stored table, about, and files that any table may have.
FILE_ROWS = 250_000
LEAST_FILES = 6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """At most as many partitions as ``rows`` narrow rows need (callers count wide rows, or rows of
    long work, several times). A table of few rows then is few files, whatever the number of
    shuffle partitions, and the number grows with the data."""
    return df.coalesce(LEAST_FILES + rows // FILE_ROWS)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes a step to the shared folder and reads it back: the plan behind it is cut, and a lost
    executor costs no more than the tasks that run. ``rows`` is as for ``in_files``."""
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else in_files(df, rows)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back_memory() -> None:
    """Hands memory that a finished task held back to the system. Workers wait for the next task,
    and what their allocators keep for it counts as the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` over the batches of a task, which gives its memory back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return whole


def released_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of one group."""

    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back_memory()

    return whole


def free_name(docs: DataFrame, name: str) -> str:
    """A name for an inner column that no column of ``docs`` has."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids up to which documents are chosen by a broadcast; some 30 MB in memory.
BROADCAST_IDS = 250_000


def chosen(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents with (left_semi) or without (left_anti) their doc_id in a stored table of ids. The
    ids are counted: few enough, they go to all tasks and no text moves; else both are shuffled."""
    name = free_name(docs, "__id")
    known = ids.select(F.col("doc_id").alias(name))
    if ids.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    return docs.join(known, docs["doc_id"].cast("long") == known[name], how)


def text_bytes(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the text as UTF-8 bytes; a null text is empty."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(*columns, text.alias("text"))


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of bytes or text, and where each value starts and ends; a null is as
    empty as Spark hands it over."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A column of bytes from all its bytes and where each value starts and ends."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def mix(values: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (a bijection), so that any of their bits can serve as a hash."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
