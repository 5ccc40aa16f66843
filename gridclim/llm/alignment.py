"""Alignment of two tokenizers' tokens over the same bytes.

Both lists of token ends rise. For each document the shorter list is searched in the longer one by
galloping: steps that double from the place of an earlier end, then halving. Ends in both cut the
tokens into groups; a token's rank less that of its group's first tells its place. All tokens of a
group are linked with all of the other side.

How often two ids are linked is counted over the corpus: each block of documents sends its distinct
pairs once, with the number of its documents that hold them, and gets their counts back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_level import ByteLevel
from .runs import groups as blocks_of
from .tables import stored

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of texts that are aligned together, as one block; one text is never cut.
BLOCK_BYTES = 2_000_000
#: Words that a task remembers with their pieces, as bytes; then it starts anew.
REMEMBERED_BYTES = 64_000_000
#: Bytes that a remembered word takes besides its own.
WORD_BYTES = 150
#: Ends between those whose place the others start from.
STRIDE = 32
#: Links of a group up to which they are listed; beyond, each pair of distinct ids is listed once.
LISTED_LINKS = 1024
#: A pair of ids as one number: the first one is shifted by so many bits. A place in a block follows.
SHIFT, PLACE = 20, 40

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ENCODED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, aligned binary,"
    " own binary, pairs binary, pair_docs binary"
)
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " aligned binary"
)


class Pieces:
    """Pieces of texts by a model whose pieces hold a blank at their start alone, so that each
    stretch of blanks and what follows it is cut by itself; stretches are remembered."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for n in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(n)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"{piece} holds a blank after other characters")
            self.bytes.append(
                bytes([int(piece[3:-1], 16)]) if self.model.is_byte(n)
                else piece.replace("▁", " ").encode()
            )
        self.forget()

    def forget(self) -> None:
        # The model puts no blank before nothing, so a single last one has its own entry.
        self.known = {" ": np.array([self.model.piece_to_id("▁")], "<u4").tobytes()}
        self.held = 0

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, before which the model puts a blank."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        stretches = [STRETCH.findall(" " + text) for text in texts]
        new = list(set().union(*stretches) - self.known.keys())
        for stretch, ids in zip(new, self.model.encode([s[1:] for s in new], num_threads=1)):
            self.known[stretch] = np.array(ids, "<u4").tobytes()
            self.held += WORD_BYTES + len(stretch) + 4 * len(ids)
        for own in stretches:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, own)), "<u4")


STRETCH = re.compile(" +[^ ]*")


def galloped(
    wanted: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray
) -> np.ndarray:
    """The place of the first end that is not below each wanted one, from ``first`` on; the end at
    ``last`` is not below it."""
    low, high = first - 1, first.copy()  # ends up to low are below
    open_ones = np.flatnonzero(ends[high] < wanted)
    step = 1
    while len(open_ones):
        low[open_ones] = high[open_ones]
        high[open_ones] = np.minimum(first[open_ones] + step, last[open_ones])
        step *= 2
        open_ones = open_ones[ends[high[open_ones]] < wanted[open_ones]]
    open_ones = np.flatnonzero(high - low > 1)
    while len(open_ones):
        middle = (low[open_ones] + high[open_ones]) // 2
        below = ends[middle] < wanted[open_ones]
        low[open_ones[below]] = middle[below]
        high[open_ones[~below]] = middle[~below]
        open_ones = open_ones[high[open_ones] - low[open_ones] > 1]
    return high


def common_ends(
    shorter: np.ndarray, longer: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ends in both lists; ``first`` and ``last`` bound the search for each
    end of the shorter one, which lies in the same text."""
    pilots = galloped(shorter[::STRIDE], longer, first[::STRIDE], last[::STRIDE])
    start = np.maximum(first, np.repeat(pilots, STRIDE)[: len(shorter)])
    place = galloped(shorter, longer, start, last)
    common = np.flatnonzero(longer[place] == shorter)
    return common, place[common]


def matched_ends(
    ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of all common ends of texts that lie behind each other, with ``n_a`` and ``n_b``
    tokens; the shorter list of each text is searched in the longer one."""
    after_a, after_b = np.cumsum(n_a), np.cumsum(n_b)
    a_short = n_a <= n_b
    found = []
    for short, ends, own, others, after in (
        (a_short, ends_a, n_a, ends_b, (after_b - n_b, after_b)),
        (~a_short, ends_b, n_b, ends_a, (after_a - n_a, after_a)),
    ):
        places = np.flatnonzero(np.repeat(short, own))
        first, last = (np.repeat(side[short], own[short]) for side in after)
        common, place = common_ends(ends[places], others, first, last - 1)
        found.append((places[common], place))
    (a, b), (more_b, more_a) = found
    return np.sort(np.concatenate([a, more_a])), np.sort(np.concatenate([b, more_b]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[fresh], np.add.reduceat(counts, fresh)


@dataclass
class Groups:
    """Tokens of some texts behind each other, cut at their common ends."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    text: np.ndarray  # of each group

    @classmethod
    def cut(cls, ids_a, ids_b, lengths_a, lengths_b, n_a, n_b) -> Groups:
        last_a, last_b = matched_ends(np.cumsum(lengths_a), np.cumsum(lengths_b), n_a, n_b)
        starts_a, starts_b = (np.append(0, last[:-1] + 1) for last in (last_a, last_b))
        if not len(last_a):
            starts_a = starts_b = np.zeros(0, np.int64)
        text = np.searchsorted(np.cumsum(n_a), starts_a, side="right")
        return cls(
            ids_a, ids_b, starts_a, starts_b, last_a + 1 - starts_a, last_b + 1 - starts_b, text
        )

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, id, id) as one number, in order, and the number of links of each."""
        links = self.sizes_a * self.sizes_b
        listed = np.flatnonzero(links <= LISTED_LINKS)
        count = links[listed]
        group = np.repeat(listed, count)
        within = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
        along = self.sizes_b[group]
        a = self.ids_a[self.starts_a[group] + within // along]
        b = self.ids_b[self.starts_b[group] + within % along]
        keys = [self.key(self.text[group], a, b)]
        counts = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > LISTED_LINKS).tolist():
            a, times_a = np.unique(
                self.ids_a[self.starts_a[g] :][: self.sizes_a[g]], return_counts=True
            )
            b, times_b = np.unique(
                self.ids_b[self.starts_b[g] :][: self.sizes_b[g]], return_counts=True
            )
            keys.append(self.key(self.text[g], a[:, None], b).ravel())
            counts.append(np.multiply.outer(times_a, times_b).ravel())
        return summed(np.concatenate(keys), np.concatenate(counts))

    @staticmethod
    def key(text, a, b) -> np.ndarray:
        return (np.int64(text) << PLACE) | (np.int64(a) << SHIFT) | np.int64(b)

    def written(self, numbers: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """Of each text: ``a1,a2|b1;a3|b2,b3``. ``numbers`` has the digits of each id with a comma
        and with the sign behind a group, first for all of one side, then of the other."""
        before_a, before_b = np.cumsum(self.sizes_a), np.cumsum(self.sizes_b)
        ends_a = np.zeros(len(self.ids_a), np.int64)
        ends_b = np.zeros(len(self.ids_b), np.int64)
        ends_a[before_a - 1] = ends_b[before_b - 1] = 1
        entry = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        place = np.arange(len(self.ids_a)) + np.repeat(before_b - self.sizes_b, self.sizes_a)
        entry[place] = 2 * self.ids_a.astype(np.int64) + ends_a
        place = np.arange(len(self.ids_b)) + np.repeat(before_a, self.sizes_b)
        entry[place] = 2 * (SIDE + self.ids_b.astype(np.int64)) + ends_b
        cells = numbers[entry]
        used = cells != 0
        ends = np.append(0, np.cumsum(used.sum(axis=1)))[np.append(0, np.cumsum(n_a + n_b))]
        whole = cells[used].tobytes()
        return [whole[start : end - 1] for start, end in zip(ends[:-1], ends[1:])]


#: Ids of the first vocabulary lie below; those of the second follow in the table of numbers.
SIDE = 1 << 17


def number_table(size_a: int, size_b: int) -> np.ndarray:
    """Digits of ids with the sign behind them, as bytes; unused ones are zero."""
    entries = [b""] * (2 * (SIDE + size_b))
    for base, size, sign in ((0, size_a, "|"), (SIDE, size_b, ";")):
        for n in range(size):
            entries[2 * (base + n)] = b"%d," % n
            entries[2 * (base + n) + 1] = f"{n}{sign}".encode()
    table = np.array(entries)
    return table.view(np.uint8).reshape(len(entries), -1)


class Aligner:
    def __init__(self, vocabulary: str, model: bytes, digest: bool):
        self.a, self.b, self.digest = ByteLevel(vocabulary, added=False), Pieces(model), digest
        self.lengths_a = np.zeros(max(self.a.ranks.values()) + 1, np.int64)
        for token, rank in self.a.ranks.items():
            self.lengths_a[rank] = len(token)
        if len(self.lengths_a) > SIDE or len(self.b.bytes) > 1 << SHIFT:
            raise ValueError("the vocabularies are too large")
        self.lengths_b = np.array(list(map(len, self.b.bytes)))
        self.numbers = number_table(len(self.lengths_a), len(self.b.bytes))

    def block(self, texts: list[str | None]) -> tuple[list[list], np.ndarray, np.ndarray]:
        """Per text the columns of COUNTS, the written groups (or their digest), and its pairs as
        places among the block's pairs, with links; the block's distinct pairs, and in how many
        texts each is."""
        plain = [text or "" for text in texts]
        of_a, of_b, valid = [], [], []
        for n, (text, b) in enumerate(zip(plain, self.b.encode(plain))):
            if not text:
                continue
            whole = (" " + text).encode()
            if b"".join(map(self.b.bytes.__getitem__, b.tolist())) != whole:
                continue
            a = self.a.encode(" " + text)
            # Merges of bytes give them back; only a byte that the vocabulary lacks could be gone.
            if self.lengths_a[a].sum() == len(whole):
                of_a.append(a)
                of_b.append(b)
                valid.append(n)
        none = np.zeros(0, np.uint32)
        rows = [[0, 0, 0, 0, b"", packed(none, none)] for _ in texts]
        if not valid:
            return rows, none, none
        n_a, n_b = np.array(list(map(len, of_a))), np.array(list(map(len, of_b)))
        ids_a, ids_b = np.concatenate(of_a), np.concatenate(of_b)
        cut = Groups.cut(ids_a, ids_b, self.lengths_a[ids_a], self.lengths_b[ids_b], n_a, n_b)
        pairs, links = cut.pairs()
        distinct, place, docs = np.unique(
            pairs & ((1 << PLACE) - 1), return_inverse=True, return_counts=True
        )
        bounds = np.searchsorted(pairs, np.arange(len(valid) + 1) << PLACE)
        n_groups = np.bincount(cut.text, minlength=len(valid))
        n_links = np.add.reduceat(links, bounds[:-1])
        for n, row in enumerate(valid):
            mine = slice(bounds[n], bounds[n + 1])
            rows[row] = [
                n_a[n], n_b[n], n_groups[n], n_links[n], b"", packed(place[mine], links[mine])
            ]
        for row, text in zip(valid, cut.written(self.numbers, n_a, n_b)):
            rows[row][4] = hashlib.sha256(text).hexdigest().encode() if self.digest else text
        return rows, distinct, docs


def packed(places: np.ndarray, links: np.ndarray) -> bytes:
    """Rising places as their differences, and links; they are small numbers."""
    steps = np.diff(places.astype(np.int64), prepend=0)
    return zstandard.compress(np.concatenate([steps, links]).astype("<u4").tobytes(), 1)


def unpacked(own: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(zstandard.decompress(own), "<u4").astype(np.int64)
    return np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]


def encoded(docs: DataFrame, vocabulary: str, model: str, digest: bool) -> DataFrame:
    """Rows of texts with their own pairs, and for each block a row with its distinct pairs."""
    with open(vocabulary, encoding="utf-8") as file, open(model, "rb") as other:
        files = docs.sparkSession.sparkContext.broadcast((file.read(), other.read()))
    schema = pa.schema(
        [(name, pa.int64()) for name in ("block", "doc_id", *COUNTS)]
        + [(name, pa.binary()) for name in ("aligned", "own", "pairs", "pair_docs")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value, digest)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for part in blocks_of(sizes, BLOCK_BYTES):
                own = batch.slice(part.start, part.stop - part.start)
                rows, pairs, docs_of = aligner.block(own.column(1).to_pylist())
                number += 1
                ids = own.column(0).to_pylist()
                rows = [(number, i, *row, None, None) for i, row in zip(ids, rows)]
                sent = (pairs.astype("<i8").tobytes(), docs_of.astype("<i8").tobytes())
                rows.append((number, *[None] * 7, *sent))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, ENCODED)


def block_pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs of each block, a row each: block, a, b, docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*(column.to_pylist() for column in batch.columns)):
                pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<i8")
                columns = [np.full(len(pairs), block), pairs >> SHIFT, pairs & ((1 << SHIFT) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), *(pa.array(c, pa.int32()) for c in columns[1:]),
                     pa.array(docs)],
                    names=["block", "a", "b", "docs"],
                )

    sent = rows.where(F.col("pairs").isNotNull()).select("block", "pairs", "pair_docs")
    return sent.mapInArrow(run, "block long, a int, b int, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """How many documents hold each pair linked, and whether that is the most of its first id."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best")
    )


def counted(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Texts of a block with the counts of their pairs."""
    order = np.lexsort((known["b"].to_numpy(), known["a"].to_numpy()))
    count = known["count"].to_numpy()[order]
    best = known["best"].to_numpy()[order].astype(np.int64)
    n_best, count_sum = [], []
    for own in rows["own"].to_pylist():
        places, links = unpacked(own)
        n_best.append(int((best[places] * links).sum()))
        count_sum.append(int((count[places] * links).sum()))
    return pa.table({
        "doc_id": rows["doc_id"],
        **{name: rows[name] for name in COUNTS},
        "n_best": pa.array(n_best, pa.int64()),
        "count_sum": pa.array(count_sum, pa.int64()),
        "aligned": rows["aligned"],
    })


def align_tokens(
    docs: DataFrame, vocabulary: str = BYTE_LEVEL, model: str = PIECES, digest: bool = False
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): the numbers of
    tokens, groups and links, the links whose pair of ids is its first id's most frequent one, the
    sum of the links' counts, and the groups as text in ``aligned``, or its SHA-256 with ``digest``.

    The count of a pair is the number of rows that hold it linked, over all rows. A null or empty
    text, and one whose bytes either tokenizer does not give back, has no tokens: zeros, and
    nothing in ``aligned``. A null doc_id stays null, repeated rows are counted each, an empty table
    gives an empty one. The vocabularies are read on the driver and handed to the tasks; their size
    does not depend on the data. Pairs are counted by grouping and joining; a block, of some 2 MB or
    one longer text, gets its own pairs' counts alone."""
    rows = stored(encoded(docs, vocabulary, model, digest), "aligned")
    pairs = block_pairs(rows)
    known = pairs.drop("docs").join(pair_counts(pairs), ["a", "b"])
    texts = rows.where(F.col("pairs").isNull()).drop("pairs", "pair_docs")
    return (
        texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(counted, ALIGNED)
    )
