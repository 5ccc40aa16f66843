"""Packing of documents into sequences by the sum-of-squares rule.

A document's ids, closed by id 0, are cut into full sequences and one rest. Rests are packed
online: a level array counts the partly filled sequences at each fill level, and a rest goes to
the level for which the sum of the squared counts becomes least. Packers work side by side on a
bounded number of rests each. At the end of a packer, the rests in sequences that are still partly
filled are laid end to end and cut, so that one of them at most needs padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_level import ByteLevel
from .tables import released

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 1024
#: Closes each document.
SEPARATOR = 0
#: Rests that one packer gets, about. The share of them that ends in a sequence with room, and so is
#: cut, falls as the packer grows: 31 % of their ids at 4096, 9 % at this number (3 % of all ids).
PACKER_ROWS = 32_768

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary,"
    " packer long"
)
PACKED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long"
)


def tokenized_pieces(docs: DataFrame, packers: int, path: str = VOCABULARY) -> DataFrame:
    """The full pieces of each row and its rest, which carries its ids; all of a row's pieces go
    to one packer, chosen by doc_id and the content of the rest."""
    with open(path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [field.split()[0] for field in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_ids = ByteLevel(vocabulary.value, added=True)
        width = vocabulary_ids.width
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(vocabulary_ids.encode(text.as_py()), np.uint32(SEPARATOR))
                coded = ids.astype("<u4").tobytes()
                pieces = [coded[at : at + 4 * LENGTH] for at in range(0, len(coded), 4 * LENGTH)]
                packer = zlib.crc32(f"{doc_id} {zlib.crc32(pieces[-1])}".encode()) % packers
                for n, piece in enumerate(pieces):
                    full = len(piece) == 4 * LENGTH
                    rows.append((
                        doc_id, n * LENGTH, len(piece) // 4, zlib.crc32(piece), len(ids),
                        None if full else np.frombuffer(piece, "<u4").astype(width).tobytes(),
                        packer,
                    ))
            columns = zip(*rows) if rows else [()] * len(names)
            types = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        released(run), PIECE
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given. Of placements that are equally good the
    fullest bin wins, among bins of one level the one that reached it last."""
    count = np.zeros(capacity + 1, np.int64)  # bins by level; 0 and full ones stay uncounted
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    chosen = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    opened = 0
    for item, length in enumerate(lengths.tolist()):
        room = capacity - length
        # By how much half the sum of squares grows, less one, from level h to h + length.
        growth = count[length : capacity + 1] - count[: room + 1]
        possible = count[: room + 1] > 0
        possible[0] = True
        growth[0] = count[length]
        double = 2 * growth + 2
        double[0] = 2 * count[length] + 1
        double[room] = 1 - 2 * count[room] if room else 0
        double = np.where(possible, double, np.iinfo(np.int64).max)
        level = room - int(np.argmin(double[::-1]))
        if level:
            target = bins[level].pop()
            count[level] -= 1
        else:
            target, opened = opened, opened + 1
        chosen[item], offsets[item] = target, level
        if level + length < capacity:
            bins[level + length].append(target)
            count[level + length] += 1
    return chosen, offsets


def laid_end_to_end(rests: list[tuple], first_bin: int, capacity: int = LENGTH) -> list[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens) one after the other, cut where a sequence is full:
    (doc_id, start, length, crc32, doc_tokens, bin, offset)."""
    placed, position = [], 0
    for doc_id, start, ids, doc_tokens in rests:
        done = 0
        while done < len(ids):
            offset = position % capacity
            part = ids[done : done + capacity - offset].astype("<u4")
            placed.append((
                doc_id, start + done, len(part), zlib.crc32(part.tobytes()), doc_tokens,
                first_bin + position // capacity, offset,
            ))
            done += len(part)
            position += len(part)
    return placed


def packed(rows: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one packer in their sequences."""
    rows = rows.sort_values(["doc_id", "start", "ids_crc32"]).reset_index(drop=True)
    length = rows["length"].to_numpy()
    bins, offsets = sum_of_squares(length)
    fill = np.bincount(bins, weights=length)
    rows["bin"], rows["offset"] = bins, offsets
    left = (fill < LENGTH)[bins]
    rests = [
        (row.doc_id, row.start, np.frombuffer(row.ids, f"<u{len(row.ids) // row.length}"),
         row.doc_tokens)
        for row in rows[left].itertuples()
    ]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]
    cut = pd.DataFrame(laid_end_to_end(rests, len(fill)), columns=names)
    kept = rows.loc[~left, names]
    out = pd.concat([kept, cut.astype(kept.dtypes)]) if len(cut) else kept
    out["sequence_id"] = (int(rows["packer"].iloc[0]) << 32) + out["bin"]
    return out[[field.split()[0] for field in PACKED.split(", ")]]


def pack_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text is the separator alone, a piece of one token. A null doc_id stays null;
    repeated rows are packed each; an empty table gives an empty one. Only the last sequence of a
    packer, of some ten thousand, can be partly filled. The vocabulary is read on the driver and
    handed to the tasks; its size does not depend on the data. A packer holds about
    ``PACKER_ROWS`` rests with their ids, at most 2 KB each (4 KB of a large vocabulary)."""
    packers = max(1, -(-docs.count() // PACKER_ROWS))
    return tokenized_pieces(docs, packers, path).groupBy("packer").applyInPandas(packed, PACKED)
