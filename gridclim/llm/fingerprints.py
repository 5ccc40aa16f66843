"""Fingerprints of documents: quartile codes of hashed byte triplets, and their length.

Each byte starts three triplets within the four bytes from it on, which are hashed to 256 buckets;
three zero bytes stand behind a text. A bucket's code tells between which quartiles of the text's
256 counts its own lies. The digest is the length class and the codes in hexadecimal digits. Two
digests differ by the sum over the buckets, where a code three apart counts six, and over the
length; the difference is bounded by what digests of codes drawn at random have on average."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import groups
from .tables import stored

BUCKETS = 256
#: Bytes that stand behind a text, so that each of its own starts all triplets.
PADDING = bytes(3)
#: Places of a triplet's second and third byte after its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3))
#: Odd multipliers of the hash.
FIRST, SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: What codes 0 to 3 apart count.
APART = np.array([0, 1, 2, 6], np.int64)
#: A length class is so many times as long as the one before; classes apart count one each.
CLASS, MOST_CLASS = 1.1, 255
#: Differences from here on are equal: 256 buckets of codes at random, which are none, one, two and
#: three apart in 4, 6, 4 and 2 of 16 cases.
LIMIT = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) // 16
#: Bytes of texts that are counted together; each text counts a thousand more for its buckets.
GROUP_BYTES, TEXT_BYTES = 2_000_000, 1000

FINGERPRINT = "doc_id long, n_chars long, fingerprint string"
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)
NAMES = [field.split()[0] for field in RESULT.split(", ")]


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Per text the counts of its triplets in each bucket."""
    lengths = np.array([len(text) for text in texts], np.int64)
    data = np.frombuffer(PADDING.join(texts) + 2 * PADDING, np.uint8).astype(np.uint32)
    ends = np.cumsum(lengths + len(PADDING))
    places = int(ends[-1])
    # The padding's own triplets go to buckets behind all others.
    base = np.repeat(np.arange(len(texts)) * BUCKETS, lengths + len(PADDING))
    for n in range(1, len(PADDING) + 1):
        base[ends - n] = len(texts) * BUCKETS
    counts = np.zeros((len(texts) + 1) * BUCKETS, np.int64)
    for kind, (second, third) in enumerate(TRIPLETS):
        value = data[:places] | data[second:][:places] << 8 | data[third:][:places] << 16
        value |= np.uint32(kind + 1) << np.uint32(24)
        value *= FIRST
        value ^= value >> np.uint32(15)
        value *= SECOND
        counts += np.bincount(base + (value >> np.uint32(24)), minlength=len(counts))
    return counts[:-BUCKETS].reshape(len(texts), BUCKETS)


class Digests:
    """Length classes and codes of some texts."""

    def __init__(self, classes: np.ndarray, codes: np.ndarray):
        self.classes, self.codes = classes, codes

    @classmethod
    def of(cls, texts: list[bytes]) -> Digests:
        counts = bucket_counts(texts)
        quarter = BUCKETS // 4
        cuts = np.partition(counts, [quarter - 1, 2 * quarter - 1, 3 * quarter - 1], axis=1)
        codes = np.zeros(counts.shape, np.uint8)
        for n in (1, 2, 3):
            codes += counts > cuts[:, n * quarter - 1, None]
        classes = [min(MOST_CLASS, int(math.log1p(len(t)) / math.log(CLASS))) for t in texts]
        return cls(np.array(classes, np.int64), codes)

    @classmethod
    def read(cls, digests: list[str]) -> Digests:
        cells = np.array([list(bytes.fromhex(digest)) for digest in digests], np.uint8)
        pairs = cells[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8) & np.uint8(3)
        return cls(cells[:, 0].astype(np.int64), pairs.reshape(len(digests), BUCKETS))

    def written(self) -> list[str]:
        four = self.codes.reshape(len(self.codes), BUCKETS // 4, 4)
        cells = four @ np.array([64, 16, 4, 1], np.uint8)
        return [
            bytes([length]).hex() + row.tobytes().hex()
            for length, row in zip(self.classes.tolist(), cells)
        ]

    def part(self, rows: slice) -> Digests:
        return Digests(self.classes[rows], self.codes[rows])

    def likeness(self, other: Digests) -> np.ndarray:
        """1 for equal digests, 0 from the largest difference that is told apart."""
        apart = np.abs(self.codes.astype(np.int8) - other.codes.astype(np.int8))
        difference = APART[apart].sum(axis=1) + np.abs(self.classes - other.classes)
        return 1 - np.minimum(difference, LIMIT) / LIMIT


def likeness(one: str, other: str) -> float:
    """How alike the texts of two fingerprints are, from 0 to 1."""
    return float(Digests.read([one]).likeness(Digests.read([other]))[0])


def text_groups(texts: list[str]) -> Iterator[slice]:
    return groups([len(text) + TEXT_BYTES for text in texts], GROUP_BYTES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored) with its number of
    code points and its fingerprint, which depends on the text alone.

    A null text is an empty one, which has a fingerprint as well. A null doc_id stays null,
    repeated rows give repeated rows, an empty table an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            found = []
            for part in text_groups(texts):
                found += Digests.of([text.encode() for text in texts[part]]).written()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()),
                 pa.array(found, pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return id_and_text(docs).mapInArrow(run, FINGERPRINT)


def id_and_text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many of the following text's first."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(ids: list, texts: list[str], digests: Digests) -> list[tuple]:
    """The columns of RESULT for each text but the last, each compared with the next one."""
    changed = [edited(*pair).encode() for pair in zip(texts, texts[1:])]
    own, after = digests.part(slice(None, -1)), digests.part(slice(1, None))
    of_changed = Digests.of(changed)
    return list(zip(
        ids, map(len, texts), (hashlib.sha256(text).hexdigest() for text in changed),
        own.written(), of_changed.written(),
        own.likeness(of_changed).tolist(), own.likeness(after).tolist(),
    ))


def as_batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Result rows, and edge rows (part, whether it is the first of its part, doc_id, text)."""
    empty = (None,) * (len(NAMES) - 1)
    rows = [(*row, None, None, None) for row in rows]
    rows += [(doc_id, *empty, part, first, text) for part, first, doc_id, text in edges]
    columns = zip(*rows) if rows else [()] * len(STREAM)
    arrays = [pa.array(column, field.type) for column, field in zip(columns, STREAM)]
    return pa.RecordBatch.from_arrays(arrays, schema=STREAM)


STREAM = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(name, pa.string()) for name in NAMES[2:5]]
    + [(name, pa.float64()) for name in NAMES[5:]]
    + [("part", pa.int32()), ("first", pa.bool_()), ("text", pa.string())]
)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the texts of a partition that have their next one in it; its first and its last
    row as edges."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    last: Digests | None = None
    for batch in batches:
        new_ids, new_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for rows in text_groups(new_texts):
            edges = [] if texts else [(part, True, new_ids[0], new_texts[0])]
            ids, texts = ids + new_ids[rows], texts + new_texts[rows]
            digests = Digests.of([text.encode() for text in texts[last is not None :]])
            if last is not None:
                digests = Digests(
                    np.concatenate([last.classes, digests.classes]),
                    np.concatenate([last.codes, digests.codes]),
                )
            found = compared(ids, texts, digests) if len(texts) > 1 else []
            yield as_batch(found, edges)
            ids, texts, last = ids[-1:], texts[-1:], digests.part(slice(-1, None))
    if texts:
        yield as_batch([], [(part, False, ids[0], texts[0])])


def compared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows that hold their next text as a third column."""
    for batch in batches:
        found = []
        for doc_id, *pair in zip(*(column.to_pylist() for column in batch.columns)):
            found += compared([doc_id], pair, Digests.of([text.encode() for text in pair]))
        columns = zip(*found) if found else [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, field.type) for c, field in zip(columns, STREAM)], names=NAMES
        )


def compared_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): its fingerprint, that
    of its edited text, and how alike its own is to that one and to the next document's.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest
    (a single row is its own next one). Null ids come last. Rows that repeat an id follow each other
    in an order that their texts decide. A null text is an empty one. An empty table gives an empty
    one.

    Rows are sorted in ranges, each by itself, and compared as they pass; what the ends of a range
    need of their neighbours is a row of each range. The driver gets the ranges' numbers."""
    spark = docs.sparkSession
    ordered = id_and_text(docs).withColumn("hash", F.xxhash64("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("text")]
    ranged = ordered.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)
    rows = stored(
        ranged.select("doc_id", "text").mapInArrow(
            chained, RESULT + ", part int, first boolean, text string"
        ),
        "fingerprints",
    )
    edges = rows.where(F.col("part").isNotNull()).select("part", "first", "doc_id", "text")
    parts = sorted(row["part"] for row in edges.where("first").select("part").collect())
    following = spark.createDataFrame(
        list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int"
    )
    heads = edges.where("first").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text")
    )
    pairs = (
        edges.where(~F.col("first")).join(following, "part").join(heads, "next_part")
        .select("doc_id", "text", "next_text")
    )
    inner = rows.where(F.col("part").isNull()).select(*NAMES)
    return inner.union(pairs.mapInArrow(compared_pairs, RESULT))
