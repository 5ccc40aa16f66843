"""Removal of passages that an earlier document has, by sorting suffixes deep and shallow.

Only suffixes that may repeat are sorted. From each 50-byte string one 32-byte anchor is selected
by its content alone, so equal strings select equal anchors. An anchor with 18 bytes on either side
is its context; the strings that hold the anchor lie within it.

1. Anchors meet by hash. Where all documents show one context, all its strings repeat, and all but
   the smallest document lose them: no text is moved.
2. Where an anchor has several contexts, the smallest document of each context brings it. The
   suffixes that start at the anchor, and those that run backwards from its end, are sorted to the
   depth of a string: multikey sorting to a shallow depth, then a blind trie for each group that is
   alike so far and differs below. What neighbours have in common tells equal strings; again the
   smallest document keeps its own.
3. Each document removes the union of its repeated strings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import (
    binary_array, bytes_and_offsets, chosen, free_name, mix, released, released_group, stored,
    text_bytes,
)

LENGTH = 50
ANCHOR = 32
#: Bytes of a context before and after its anchor; offsets at which a string can start in it.
SIDE = LENGTH - ANCHOR
CONTEXT = ANCHOR + 2 * SIDE
OFFSETS = SIDE + 1
#: The smallest of the short pieces of a string decides which anchor is selected.
PIECE = 4 + (ANCHOR - 4) % OFFSETS
#: Depth in bytes to which all suffixes are sorted at once.
SHALLOW = 40
#: Window starts whose hashes are formed together; a place among them fits PLACE_BITS.
SEGMENT = 1 << 20
PLACE_BITS = np.uint64(21)
#: Bytes of texts whose anchors are packed together.
PACKED_BYTES = 8_000_000
#: Bytes of text, and contexts, that one task gets, about.
BUCKET_BYTES = 16_000_000
BUCKET_CONTEXTS = 20_000
LEAST_BUCKETS = 64
#: Anchors with more contexts than this are not gathered; their strings are counted one by one.
GATHERED = 4096

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)
ALL, SOME, SOME_OF_MANY = 1, 2, 3


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the view copies nothing."""
    n = max(len(data) - 7, 0)
    return np.ndarray((n,), "<u8", buffer=data, strides=(1,)) if n else np.zeros(0, np.uint64)


def word_hash(words: Iterable[np.ndarray], start: int) -> np.ndarray:
    """Hash of columns of words, row by row."""
    value = np.uint64(start)
    for word in words:
        value = (value ^ word) * BASE
        value = value ^ (value >> np.uint64(29))
    return mix(value)


def selected(data: np.ndarray) -> np.ndarray:
    """For each window of ``data`` the place of its anchor: the smallest piece's offset in the
    window, reduced to the offsets that an anchor can have. As anchor and piece lengths differ by a
    multiple of their number, places never fall from one window to the next."""
    words = words_at(data)
    n = len(data) - PIECE + 1
    value = (words[:n] * BASE) ^ (words[PIECE - 8 : PIECE - 8 + n] * STEP)
    value ^= value >> np.uint64(32)
    value *= BASE
    # The place in the low bits: the first of equal pieces is the smallest.
    value >>= PLACE_BITS
    value <<= PLACE_BITS
    value |= np.arange(n, dtype=np.uint64)
    span, size = LENGTH - PIECE + 1, 1
    while size < span:
        step = min(size, span - size)
        value = np.minimum(value[:-step], value[step:])
        size += step
    start = np.arange(len(value))
    offset = (value & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64) - start
    # An offset is below twice the number of anchor offsets.
    return start + np.where(offset >= OFFSETS, offset - OFFSETS, offset)


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the anchors of texts that lie behind each other in ``data``."""
    end_of = np.repeat(starts[1:], np.diff(starts))
    found = [np.zeros(0, np.int64)]
    for low in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        place = selected(data[low : low + SEGMENT + LENGTH - 1]) + low
        # A window of a text ends before the text does.
        start = np.arange(low, low + len(place))
        found.append(place[start + LENGTH <= end_of[start]])
    place = np.concatenate(found)
    place = place[np.diff(place, prepend=-1) > 0]
    return np.searchsorted(starts, place, side="right") - 1, place


class Contexts:
    """The contexts of anchors: ``left`` and ``right`` are the bytes of the text before and after
    each anchor, up to SIDE; what lies outside of the text counts as zero."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.text, place = anchors(data, starts)
        self.left = np.minimum(place - starts[self.text], SIDE)
        self.right = np.minimum(starts[self.text + 1] - place - ANCHOR, SIDE)
        self.padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
        self.place = place  # of the context in the padded bytes

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """The bytes of the chosen contexts."""
        if not len(chosen):
            return np.zeros((0, CONTEXT), np.uint8)
        views = np.lib.stride_tricks.sliding_window_view(self.padded, CONTEXT)
        rows, at = views[self.place[chosen]], np.arange(-SIDE, ANCHOR + SIDE)
        left, right = self.left[chosen, None], self.right[chosen, None]
        cut = np.flatnonzero((left + right)[:, 0] < 2 * SIDE)
        inside = (at >= -left[cut]) & (at < ANCHOR + right[cut])
        rows[cut] = np.where(inside, rows[cut], 0)
        return rows

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the anchor, and of the whole context with its bounds."""
        words = words_at(self.padded)
        # The last word overlaps the one before it.
        offsets = [*range(0, CONTEXT - 7, 8), CONTEXT - 8]
        context = np.zeros(len(self.place), np.uint64)
        whole = np.flatnonzero(self.left + self.right == 2 * SIDE)
        context[whole] = word_hash((words[self.place[whole] + n] for n in offsets), 1)
        cut = np.flatnonzero(self.left + self.right < 2 * SIDE)
        rows = self.rows(cut)
        parts = (np.ascontiguousarray(rows[:, n : n + 8]).view("<u8").ravel() for n in offsets)
        bounds = (self.left[cut] * (SIDE + 1) + self.right[cut] + 2).astype(np.uint64)
        context[cut] = mix(word_hash(parts, 1) ^ mix(bounds))
        anchor = word_hash(
            (words[self.place + SIDE + n] for n in range(0, ANCHOR, 8)), 2
        )
        return anchor, context


def runs_of(batch: pa.RecordBatch, column: int, most: int = SEGMENT):
    """(rows of the batch, bytes, starts) for runs of whole texts."""
    data, starts = bytes_and_offsets(batch.column(column))
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low), data[starts[low] : starts[high]], (
            starts[low : high + 1] - starts[low]
        )
        low = high


def listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """The row of each entry of a column of lists of structs, and the entries' fields."""
    counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    entries = column.flatten()
    rows = np.repeat(np.arange(len(column)), counts)
    return rows, *(pa.compute.struct_field(entries, name).to_numpy() for name in names)


def in_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a key within a row."""
    return mix(key.view(np.uint64) ^ mix(row.astype(np.uint64) + np.uint64(1)))


def looked_up(wanted: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where there is none; values of a key that comes again are
    put together bit by bit."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, values = keys[heads], np.bitwise_or.reduceat(values, heads)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


# Step 1: anchors by hash.

PACKED = (
    "bucket int, docs binary, anchor binary, context binary, doc binary,"
    " sure_context binary, sure_doc binary"
)
REPLIES = "doc_id long, context long, kind int"


def packed_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """The anchors of some texts, dealt to buckets by their hash and packed as columns of bytes. Of
    equal contexts among them the smallest document's goes; the others are sure to repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("bucket", pa.int32()), *((n.split()[0], pa.binary()) for n in PACKED.split(", ")[1:])
        ])
        for batch in batches:
            for rows, data, starts in runs_of(batch, 1, PACKED_BYTES):
                parts, before = [], 0
                for part, own, own_starts in runs_of(rows, 1):
                    found = Contexts(own, own_starts)
                    parts.append((*found.keys(), found.text + before))
                    before += len(part)
                ids = rows.column(0).to_numpy()
                packed = list(dealt(*map(np.concatenate, zip(*parts)), ids, buckets))
                yield pa.RecordBatch.from_pylist(packed, schema=schema)

    return docs.mapInArrow(released(run), PACKED)


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the anchor, so that sorted anchors lie in order of their buckets."""
    return ((anchor >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_anchor(anchor, context, ids) -> np.ndarray:
    """Order by anchor, and within an anchor by context and id. Few anchors repeat, so one sort
    does nearly all."""
    order = np.argsort(anchor)
    ordered = anchor[order]
    alike = np.zeros(len(order), bool)
    alike[1:] = ordered[1:] == ordered[:-1]
    alike[:-1] |= alike[1:].copy()
    again = order[alike]
    order[alike] = again[np.lexsort([ids[again], context[again], anchor[again]])]
    return order


def dealt(anchor, context, doc, ids, buckets: int) -> Iterator[dict]:
    order = by_anchor(anchor, context, ids[doc])
    anchor, context, doc = anchor[order], context[order], doc[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
    least = ids[doc[new]][np.cumsum(new) - 1]
    # A document that shows a context twice is no larger than itself.
    sure = ~new & (ids[doc] > least)
    sure_context, sure_doc = context[sure], doc[sure]
    spread = np.argsort(sure_doc % buckets, kind="stable")
    sure_context, sure_doc = sure_context[spread], sure_doc[spread]
    anchor, context, doc = anchor[new], context[new], doc[new]
    numbers = np.arange(buckets + 1)
    cuts = np.searchsorted(bucket_of(anchor, buckets), numbers)
    sure_cuts = np.searchsorted(sure_doc % buckets, numbers)
    for one in range(buckets):
        rows, known = slice(*cuts[one : one + 2]), slice(*sure_cuts[one : one + 2])
        both = np.concatenate([doc[rows], sure_doc[known]])
        if not len(both):
            continue
        used, number = np.unique(both, return_inverse=True)
        number = number.astype("<u2" if len(used) < 1 << 16 else "<u4")
        n = rows.stop - rows.start
        yield {
            "bucket": one,
            "docs": ids[used].astype("<i8").tobytes(),
            # The bucket holds the highest bits; the lowest 40 tell the anchors of a bucket apart.
            "anchor": anchor[rows].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
            "context": context[rows].astype("<u8").tobytes(),
            "doc": number[:n].tobytes(),
            "sure_context": sure_context[known].astype("<u8").tobytes(),
            "sure_doc": number[n:].tobytes(),
        }


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row["docs"], "<i8")
    kind = "<u2" if len(ids) < 1 << 16 else "<u4"
    short = np.frombuffer(row["anchor"], np.uint8).reshape(-1, 5)
    anchor = np.zeros((len(short), 8), np.uint8)
    anchor[:, :5] = short
    return (
        anchor.view("<u8").ravel(),
        np.frombuffer(row["context"], "<u8"),
        ids[np.frombuffer(row["doc"], kind)],
        np.frombuffer(row["sure_context"], "<u8"),
        ids[np.frombuffer(row["sure_doc"], kind)],
    )


def replies(table: pa.Table) -> pa.Table:
    """For one bucket, what each document is told of its contexts: that all strings in it repeat,
    or that it is the smallest with this context but not with this anchor."""
    parts = [unpacked(row) for row in table.to_pylist()]
    anchor, context, doc, sure_context, sure_doc = map(np.concatenate, zip(*parts))
    order = by_anchor(anchor, context, doc)
    anchor, context, doc = anchor[order], context[order], doc[order]
    new_anchor = np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new = new_anchor.copy()
    new[1:] |= context[1:] != context[:-1]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
    kind = np.where(doc > least, ALL, 0)
    heads = np.flatnonzero(new_anchor)
    if len(heads):
        group = np.cumsum(new_anchor) - 1
        classes = np.add.reduceat(new.astype(np.int64), heads)[group]
        several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        brings = new & (classes > 1) & several[group]
        kind = np.where(brings, np.where(classes > GATHERED, SOME_OF_MANY, SOME), kind)
    told = kind > 0
    return pa.table({
        "doc_id": pa.array(np.concatenate([doc[told], sure_doc])),
        "context": pa.array(np.concatenate([context[told], sure_context]).view(np.int64)),
        "kind": pa.array(
            np.concatenate([kind[told], np.full(len(sure_doc), ALL)]).astype(np.int32)
        ),
    })


# Step 2: suffixes of the contexts that differ.


class BlindTrie:
    """Orders strings by the bytes at which they branch; a string is compared in full with one
    leaf alone, to find how deep it goes."""

    class Node:
        __slots__ = ("depth", "children")

        def __init__(self, depth: int):
            self.depth, self.children = depth, {}

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: BlindTrie.Node | list[int] | None = None
        for n in range(len(strings)):
            self.insert(n)

    def insert(self, n: int) -> None:
        if self.root is None:
            self.root = [n]
            return
        text, place = self.strings[n], self.root
        while isinstance(place, BlindTrie.Node):  # blindly to some leaf
            place = place.children.get(text[place.depth]) or next(iter(place.children.values()))
        other = self.strings[place[0]]
        common = next((i for i, (a, b) in enumerate(zip(text, other)) if a != b), len(text))
        if common == len(text):
            place.append(n)
            return
        above, key, place = None, None, self.root
        while isinstance(place, BlindTrie.Node) and place.depth < common:
            above, key = place, text[place.depth]
            place = place.children[key]
        if isinstance(place, BlindTrie.Node) and place.depth == common:
            place.children[text[common]] = [n]
            return
        branch = BlindTrie.Node(common)
        branch.children = {other[common]: place, text[common]: [n]}
        if above is None:
            self.root = branch
        else:
            above.children[key] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Groups of equal strings in their order."""
        stack = [] if self.root is None else [self.root]
        while stack:
            place = stack.pop()
            if isinstance(place, list):
                yield place
            else:
                stack.extend(place.children[k] for k in sorted(place.children, reverse=True))


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of equal length, and whether each differs from the one before it."""
    depth = min(SHALLOW, rows.shape[1] // 8 * 8)
    words = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    new = np.ones(len(rows), bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1)
    rest = rows[order, depth:]
    # Groups alike to the shallow depth whose members differ below it.
    differs = np.zeros(len(rows), bool)
    differs[1:] = (rest[1:] != rest[:-1]).any(axis=1) & ~new[1:]
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(rows))
    deep = np.flatnonzero(np.add.reduceat(differs, heads) > 0) if len(heads) else heads
    for group in deep:
        low, high = heads[group], ends[group]
        leaves = BlindTrie([bytes(x) for x in rest[low:high]]).leaves()
        place, arranged = low, order[low:high].copy()
        for leaf in leaves:
            order[place : place + len(leaf)] = arranged[leaf]
            new[place], new[place + 1 : place + len(leaf)] = True, False
            place += len(leaf)
    return order, new


def common_lengths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes, and how many bytes each has in common with the one before it."""
    order, _ = sorted_suffixes(rows)
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.zeros(len(rows), np.int64)
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, common


def classes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each suffix that those alike to this depth share."""
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(common < depth)
    return classes


def repeated_masks(table: pa.Table) -> pa.Table:
    """(doc_id, context, mask): bit o says that the string at offset o of the context also starts
    in a smaller document. All contexts of an anchor are in the table.

    A string is an anchor with some bytes before and the others behind it. So two orders tell equal
    strings: that of the suffixes that start with the anchor, and that of the texts read backwards
    from the anchor's end, each with the lengths that neighbours have in common."""
    rows = np.frombuffer(
        b"".join(table.column("bytes").to_pylist()), np.uint8
    ).reshape(-1, CONTEXT)
    doc = table.column("doc_id").to_numpy()
    left, right = table.column("left").to_numpy(), table.column("right").to_numpy()
    forwards = common_lengths(rows[:, SIDE:])
    backwards = common_lengths(rows[:, : SIDE + ANCHOR][:, ::-1])
    mask = np.zeros(len(doc), np.int64)
    for offset in range(OFFSETS):
        valid = np.flatnonzero((offset >= SIDE - left) & (offset <= right))
        if len(valid) < 2:
            continue
        before = classes_at(*backwards, ANCHOR + SIDE - offset)
        behind = classes_at(*forwards, ANCHOR + offset)
        string = (before * (len(doc) + 1) + behind)[valid]
        order = np.argsort(string, kind="stable")
        string, own = string[order], doc[valid][order]
        heads = np.flatnonzero(np.diff(string, prepend=-1))
        least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(own))))
        mask[valid[order[own > least]]] |= 1 << offset
    hit = mask > 0
    return pa.table({
        "doc_id": pa.array(doc[hit]), "context": pa.array(table.column("context").to_numpy()[hit]),
        "mask": pa.array(mask[hit]),
    })


MASKS = "doc_id long, context long, mask long"
EVERY = (1 << OFFSETS) - 1


def brought_contexts(texts: DataFrame) -> DataFrame:
    """The contexts that documents are asked for (column asked: list of keys and kinds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in runs_of(batch, 1):
                found = Contexts(data, starts)
                anchor, key = found.keys()
                row, asked, kinds = listed(part.column("asked"), "context", "kind")
                kind = looked_up(in_row(found.text, key), in_row(row, asked), kinds)
                hit = np.flatnonzero(kind)
                rows = found.rows(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[hit].view(np.int64)),
                     pa.array(part.column(0).to_numpy()[found.text[hit]]),
                     pa.array(key[hit].view(np.int64)), pa.array(kind[hit]),
                     binary_array(rows.ravel(), np.arange(len(hit) + 1) * CONTEXT),
                     pa.array(found.left[hit].astype(np.int32)),
                     pa.array(found.right[hit].astype(np.int32))],
                    BROUGHT_NAMES,
                )

    return texts.select("doc_id", "text", "asked").mapInArrow(
        released(run), BROUGHT
    )


BROUGHT = (
    "anchor long, doc_id long, context long, kind int, bytes binary, left int, right int"
)
BROUGHT_NAMES = [field.split()[0] for field in BROUGHT.split(", ")]


def masks_of_gathered(brought: DataFrame, buckets: int) -> DataFrame:
    few = brought.where(F.col("kind") == SOME).dropDuplicates(["doc_id", "context"])
    bucket = F.pmod(F.col("anchor"), F.lit(buckets))
    return few.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(
        released_group(repeated_masks), MASKS
    )


def masks_of_many(brought: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts, string by string: the smallest document of a
    string is found by an aggregation that sums up before rows move."""
    many = brought.where(F.col("kind") == SOME_OF_MANY).dropDuplicates(["doc_id", "context"])
    offset = F.explode(F.sequence(F.lit(SIDE) - F.col("left"), F.col("right")))
    strings = many.withColumn("offset", offset).select(
        "doc_id", "context", "offset",
        F.substring("bytes", F.col("offset") + 1, F.lit(LENGTH)).alias("string"),
    )
    least = strings.groupBy("string").agg(F.min("doc_id").alias("least"))
    return (
        strings.join(least, "string")
        .where(F.col("doc_id") > F.col("least"))
        .groupBy("doc_id", "context")
        .agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
    )


# Step 3: removal.


def removed(data: np.ndarray, starts: np.ndarray, marks: pa.Array) -> np.ndarray:
    """Which bytes of some texts their marks cover."""
    edges = np.zeros(len(data) + 1, np.int32)
    row, context, masks = listed(marks, "context", "mask")
    if len(row):
        found = Contexts(data, starts)
        key = found.keys()[1]
        mask = looked_up(in_row(found.text, key), in_row(row, context), masks)
        for offset in range(OFFSETS):
            valid = (mask >> offset & 1 > 0) & (offset >= SIDE - found.left)
            valid &= offset <= found.right
            start = found.place[valid] - SIDE + offset
            edges += np.bincount(start, minlength=len(edges)).astype(np.int32)
            edges -= np.bincount(start + LENGTH, minlength=len(edges)).astype(np.int32)
    return np.cumsum(edges[:-1]) > 0


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text a smaller document has, too."""
    digest = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")), 256)
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest).alias("digest")
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    several = first.where(F.col("n") > 1)
    return rows.join(several, "digest").where(F.col("doc_id") > F.col("least"))


def repeated_marks(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(doc_id, marks): the contexts of a document that hold strings of smaller documents."""
    own = chosen(docs.where(F.col("doc_id").isNotNull()), copied, "left_anti")
    own = text_bytes(own, F.col("doc_id").cast("long").alias("doc_id"))
    own = own.where(F.length("text") >= LENGTH)
    size = own.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    n = docs.count()
    told = stored(
        packed_anchors(own, buckets).groupBy("bucket").applyInArrow(
            released_group(replies), REPLIES
        ),
        "suffix-replies", 40 * n,
    )
    some = told.where(F.col("kind") != ALL).groupBy("doc_id").agg(
        F.collect_list(F.struct("context", "kind")).alias("asked")
    )
    some = stored(some, "suffix-asked", 10 * n)
    texts = chosen(own, some.select("doc_id"), "left_semi").join(some, "doc_id")
    brought = stored(brought_contexts(texts), "suffix-contexts", 100 * n)
    groups = 1 + brought.count() // BUCKET_CONTEXTS
    masks = (
        told.where(F.col("kind") == ALL)
        .select("doc_id", "context", F.lit(EVERY).cast("long").alias("mask"))
        .unionByName(masks_of_gathered(brought, groups))
        .unionByName(masks_of_many(brought))
    )
    return stored(
        masks.groupBy("doc_id").agg(F.collect_list(F.struct("context", "mask")).alias("marks")),
        "suffix-marks", 40 * n,
    )


def dedup_passages(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the text that is left, and suffix_n_bytes, suffix_n_removed,
    suffix_n_spans and suffix_kept, the bytes that are left. A removed string can end within a
    character; what is left of such a character is in suffix_kept, but not in the text.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller
    doc_id; matches never cross documents. A null or empty text stays an empty one. Rows without
    doc_id lose nothing and take nothing from others. Rows that repeat a doc_id are one document
    with one text and do not take from each other. An empty table gives an empty one. Extra columns
    come back as they are; only columns named like the new ones are replaced."""
    new = ["suffix_n_bytes", "suffix_n_removed", "suffix_n_spans", "suffix_kept"]
    docs = docs.drop(*new)
    names = docs.columns
    n = docs.count()
    copied = stored(copies(docs).select("doc_id").distinct(), "suffix-copies", n)
    marks = repeated_marks(docs, copied)
    marked_id, own_marks = free_name(docs, "__id"), free_name(docs, "__marks")
    known = marks.withColumnsRenamed({"doc_id": marked_id, "marks": own_marks})
    marked = chosen(docs, marks.select("doc_id"), "left_semi").join(
        known, docs["doc_id"].cast("long") == known[marked_id]
    ).drop(marked_id)
    hit = stored(marks.select("doc_id").unionByName(copied), "suffix-hit", n)
    untouched = docs.where(F.col("doc_id").isNull()).unionByName(
        chosen(docs.where(F.col("doc_id").isNotNull()), hit, "left_anti")
    )
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    size, nothing = F.length(data).cast("long"), F.lit(0).cast("long")
    untouched = untouched.withColumns(dict(zip(new, (size, nothing, nothing, data))))
    # A copy loses all, if it is long enough to hold a string.
    gone = F.length(data) >= LENGTH
    copied_rows = chosen(docs, copied, "left_semi").withColumns(dict(zip(new, (
        size, F.when(gone, size).otherwise(nothing), gone.cast("long"),
        F.when(gone, F.lit("").cast("binary")).otherwise(data),
    ))))
    whole = untouched.unionByName(copied_rows).withColumn("text", F.col(new[-1]).cast("string"))
    schema = docs.select(*[
        F.lit("").alias("text") if name == "text" else F.col(f"`{name}`") for name in names
    ]).schema
    for name, kind in zip(new, ("long", "long", "long", "binary")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in runs_of(batch, batch.schema.get_field_index("text")):
                gone = removed(data, starts, part.column(own_marks))
                size = np.diff(starts)
                # A run opens where the byte before, in the same text, stays.
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens[starts[:-1][size > 0]] = gone[starts[:-1][size > 0]]
                counted = [np.concatenate([[0], np.cumsum(x)])[starts] for x in (gone, opens)]
                lost, spans = (np.diff(x) for x in counted)
                kept = binary_array(data[~gone], starts - counted[0])
                texts = [t.as_py().decode("utf-8", "ignore") for t in kept]
                columns = [
                    pa.array(texts, pa.string()) if name == "text" else part.column(name)
                    for name in names
                ]
                columns += [pa.array(x.astype(np.int64)) for x in (size, lost, spans)]
                yield pa.RecordBatch.from_arrays([*columns, kept], [*names, *new])

    own = marked.select(*[F.col(f"`{n}`") for n in [*names, own_marks]])
    cut = own.mapInArrow(released(run), schema)
    return cut.unionByName(whole.select(*cut.columns))
