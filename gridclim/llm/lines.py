"""Line dedup that can be taken back.

Exact tables hold which document has which line: the references (key, doc_id) and, per key, their
number and the largest doc_id. Cuckoo filters, one per shard of the key space, hold the keys that
reached the threshold. A line is tested against its shard's filter; only those that pass meet the
exact table, which removes the filter's false positives. Inserting and removing documents changes
references, counts of the touched keys, and the filters' fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chosen, free_name, mix, released, stored, text_bytes

BLANKS = b" \t\n\x0b\x0c\r"
#: Keys of a shard, about; a filter of two slots a key and two bytes a slot stays near 1 MB.
SHARD_KEYS = 1 << 18
#: Filters are handed to all tasks up to this size together; beyond it lines go to their shard.
SHARED_FILTER_BYTES = 64_000_000
SLOTS = 4
KICKS = 500


@dataclass(frozen=True)
class LineRules:
    """Lines of at least ``least_chars`` code points found in at least ``least_docs`` documents."""

    least_chars: int = 40
    least_docs: int = 5


def line_key(line: bytes) -> bytes:
    """Blanks at both ends stripped, A-Z lowered."""
    return line.strip(BLANKS).lower()


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def long_key(line: bytes, least_chars: int) -> bytes | None:
    """128-bit digest of the key if it is long enough."""
    key = line_key(line)
    if len(key) < least_chars or code_points(key) < least_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Two candidate buckets of four 16-bit fingerprints for each key. Each key is added once, so
    that a fingerprint can be taken out again."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS; 0 is free

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """Buckets for about half load; doubled until all keys have a place."""
        size = 1 << max(2, (len(keys) * 2 // SLOTS).bit_length())
        while True:
            built = cls(np.zeros((size, SLOTS), np.uint16))
            if all(built.add(key) for key in keys):
                return built
            size *= 2

    @staticmethod
    def hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket (before reduction) and fingerprint of keys given as pairs of 64 bits."""
        spread = mix(keys[:, 0])
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return spread, np.where(prints == 0, np.uint16(1), prints)

    def _places(self, spread: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        first = spread & mask
        return first, (first ^ mix(prints.astype(np.uint64))) & mask

    def add(self, key: bytes) -> bool:
        spread, prints = self.hashes(as_pairs([key]))
        first, second = (int(x[0]) for x in self._places(spread, prints))
        mark = prints[0]
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = second
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            moved = mix(np.array([mark], np.uint64))[0]
            bucket = int((np.uint64(bucket) ^ moved) & np.uint64(len(self.table) - 1))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def remove(self, key: bytes) -> bool:
        """Takes one fingerprint of a key out that was added before."""
        spread, prints = self.hashes(as_pairs([key]))
        for place in self._places(spread, prints):
            bucket = int(place[0])
            held = np.flatnonzero(self.table[bucket] == prints[0])
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        spread, prints = self.hashes(keys)
        first, second = (place.astype(np.int64) for place in self._places(spread, prints))
        own = prints[:, None]
        return (self.table[first] == own).any(axis=1) | (self.table[second] == own).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())


def as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (pairs[:, 1] >> np.uint64(16)) % np.uint64(shards)


@dataclass(frozen=True)
class LineState:
    """references (key, doc_id); counts (key, n_docs, keep_doc) of the keys at the threshold;
    filters (shard, slots) over these keys."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    rules: LineRules


def line_references(docs: DataFrame, rules: LineRules) -> DataFrame:
    """(key, doc_id) of long lines, once for each row. Rows without doc_id have no references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = text.as_py().split(b"\n")
                own = {long_key(line, rules.least_chars) for line in lines} - {None}
                keys.extend(own)
                ids.extend([doc_id] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"]
            )

    known = docs.where(F.col("doc_id").isNotNull())
    rows = text_bytes(known, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(released(run), "key binary, doc_id long")


def reference_counts(references: DataFrame, rules: LineRules) -> DataFrame:
    """Exact counts of the keys at the threshold, of distinct references. Summed before they move,
    so a line that all documents share is a few rows."""
    return (
        references.groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"))
        .where(F.col("n_docs") >= rules.least_docs)
    )


def cuckoo_filters(counts: DataFrame, shards: int) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(map(bytes, rows["key"]))
        made = CuckooFilter.of(keys)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "slots": [made.to_bytes()]})

    return with_shard(counts, shards).groupBy("shard").applyInPandas(
        build, "shard long, slots binary"
    )


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shard_of(as_pairs(batch.column("key").to_pylist()), shards).astype(np.int64)
            yield batch.append_column("shard", pa.array(own))

    schema = rows.select("*").schema.add("shard", "long")
    return rows.mapInArrow(run, schema)


def build_state(docs: DataFrame, rules: LineRules = LineRules()) -> LineState:
    references = line_references(docs, rules).distinct()
    return _state(stored(references, "line-references", 20 * docs.count()), rules)


def _state(references: DataFrame, rules: LineRules) -> LineState:
    most = references.count() // rules.least_docs
    counts = stored(reference_counts(references, rules), "line-counts", most)
    shards = 1 + counts.count() // SHARD_KEYS
    filters = stored(cuckoo_filters(counts, shards), "line-filters", SHARD_KEYS * shards)
    return LineState(references, counts, filters, shards, rules)


def insert_documents(state: LineState, docs: DataFrame) -> LineState:
    """The state with ``docs`` added."""
    new = line_references(docs, state.rules)
    references = stored(state.references.unionByName(new).distinct(), "line-references")
    return _changed(state, references, new)


def remove_documents(state: LineState, ids: DataFrame) -> LineState:
    """The state without the documents in ``ids`` (doc_id), as if they had never come."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"))
    gone = state.references.join(ids, "doc_id", "left_semi")
    left = state.references.join(ids, "doc_id", "left_anti").select("key", "doc_id")
    references = stored(left, "line-references")
    return _changed(state, references, gone)


def _changed(state: LineState, references: DataFrame, changed: DataFrame) -> LineState:
    """Counts are made anew for the keys in ``changed`` alone, and filters take in or give up the
    keys that crossed the threshold."""
    touched = stored(changed.select("key").distinct(), "line-touched")
    fresh = reference_counts(references.join(touched, "key", "left_semi"), state.rules)
    kept = state.counts.join(touched, "key", "left_anti")
    counts = stored(kept.unionByName(fresh), "line-counts")
    risen = counts.join(state.counts, "key", "left_anti").select("key", F.lit(1).alias("step"))
    fallen = state.counts.join(counts, "key", "left_anti").select("key", F.lit(-1).alias("step"))
    crossed = with_shard(risen.unionByName(fallen), state.shards)

    def update(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int((left if len(left) else right)["shard"].iloc[0])
        made = CuckooFilter.from_bytes(left["slots"].iloc[0]) if len(left) else CuckooFilter.of([])
        fits = all(
            made.remove(bytes(key)) if step < 0 else made.add(bytes(key))
            for step, key in sorted(zip(right["step"], map(bytes, right["key"])))
        )
        return pd.DataFrame({"shard": [shard], "slots": [made.to_bytes() if fits else None]})

    filters = state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(
        update, "shard long, slots binary"
    )
    filters = stored(filters, "line-filters")
    if filters.where(F.col("slots").isNull()).count():  # one is full: larger ones from the counts
        filters = stored(cuckoo_filters(counts, state.shards), "line-filters")
    return LineState(references, counts, filters, state.shards, state.rules)


def dropped_keys(state: LineState) -> DataFrame:
    """(doc_id, keys): the keys whose lines a document loses."""
    size = state.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
    passing = (
        passing_shared(state) if size <= SHARED_FILTER_BYTES else passing_by_shard(state)
    )
    return (
        passing.join(state.counts.select("key", "keep_doc"), "key")
        .where(F.col("doc_id") != F.col("keep_doc"))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("drop_keys"))
    )


def passing_shared(state: LineState) -> DataFrame:
    """References whose key passes its shard's filter. The filters' size was checked."""
    shards = state.shards
    slots = {row["shard"]: bytes(row["slots"]) for row in state.filters.collect()}
    shared = state.references.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {shard: CuckooFilter.from_bytes(data) for shard, data in shared.value.items()}
        for batch in batches:
            pairs = as_pairs(batch.column("key").to_pylist())
            own, passed = shard_of(pairs, shards), np.zeros(len(pairs), bool)
            for shard, keys in made.items():
                here = own == shard
                passed[here] = keys.contains(pairs[here])
            yield batch.filter(pa.array(passed))

    return state.references.mapInArrow(run, state.references.schema)


def passing_by_shard(state: LineState) -> DataFrame:
    """The same, with each shard's references and filter brought together. Salted: a shard's
    references are dealt to several tasks, and its filter goes to each of them."""
    salts = 16
    references = with_shard(state.references, state.shards).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    )
    filters = state.filters.withColumn(
        "salt", F.explode(F.array(*[F.lit(n).cast("long") for n in range(salts)]))
    )

    def run(key, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]):
        made = [CuckooFilter.from_bytes(s) for b in right for s in b.column("slots").to_pylist()]
        for batch in left:
            pairs = as_pairs(batch.column("key").to_pylist())
            passed = made[0].contains(pairs) if made else np.zeros(len(pairs), bool)
            yield batch.select(["key", "doc_id"]).filter(pa.array(passed))

    grouped = references.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt"))
    return grouped.applyInArrow(
        lambda key, left, right: _as_table(run(key, left.to_batches(), right.to_batches())),
        "key binary, doc_id long",
    )


def _as_table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])
    return pa.Table.from_batches(list(batches), schema)


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """All columns of ``docs`` with the text that is left, and line_n_lines and line_n_dropped.

    A document is a doc_id: rows that repeat it count once and lose the same lines. A null or
    empty text is one empty line and comes back as an empty text. Rows without doc_id neither
    count nor lose lines. Of the documents that share a line, the largest doc_id keeps it. An
    empty table gives an empty one. Extra columns come back as they are; only columns named like
    the two new ones are replaced."""
    state = build_state(docs, rules)
    new = ["line_n_lines", "line_n_dropped"]
    docs = docs.drop(*new)
    names = docs.columns
    drops = stored(dropped_keys(state), "line-drops")
    # The others keep their text, which neither moves nor leaves Spark's memory.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    others = docs.where(F.col("doc_id").isNull()).unionByName(
        chosen(docs.where(F.col("doc_id").isNotNull()), drops, "left_anti")
    ).withColumns({
        "line_n_lines": n_lines.cast("long"), "line_n_dropped": F.lit(0).cast("long"),
    }).withColumn("text", text)
    drop_id, own_keys = free_name(docs, "__line_doc"), free_name(docs, "__line_keys")
    known = drops.withColumnsRenamed({"doc_id": drop_id, "drop_keys": own_keys})
    # By shuffle at every size: a document can lose very many lines, so the keys of a few documents
    # are no smaller a table than their number tells.
    joined = chosen(docs, drops, "left_semi").join(
        known.hint("shuffle_merge"), docs["doc_id"].cast("long") == known[drop_id]
    ).drop(drop_id)
    schema = docs.select(*[
        F.lit("").alias("text") if name == "text" else F.col(f"`{name}`") for name in names
    ]).schema.add(new[0], "long").add(new[1], "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, losses = [], [], []
            keys = batch.column(own_keys).to_pylist()
            for text, own in zip(batch.column("text").to_pylist(), keys):
                lines = (text or "").encode().split(b"\n")
                drop = set(own)
                kept = [line for line in lines if long_key(line, rules.least_chars) not in drop]
                texts.append(b"\n".join(kept).decode())
                totals.append(len(lines))
                losses.append(len(lines) - len(kept))
            columns = [
                pa.array(texts, pa.string()) if name == "text" else batch.column(name)
                for name in names
            ] + [pa.array(totals, pa.int64()), pa.array(losses, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    cut = joined.mapInArrow(released(run), schema)
    return cut.unionByName(others.select(*cut.columns))
