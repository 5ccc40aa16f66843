"""Quality rules: counts of words, symbols and repetition, and compression bands.

The verdict of the method compares zstandard ratios (compressed by raw bytes) of the whole text
and of its fixed chunks with limits that depend on the length: repetitive text falls below the
band, incompressible text lies above it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import give_back_memory, text_bytes

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, ratio double, odd_chunks double, kept boolean"
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
WINDOW = 8


@dataclass(frozen=True)
class CompressionBands:
    """Limits by length. ``bands`` holds (shortest length in bytes, least ratio, largest ratio);
    texts shorter than the first band are not judged. A text is also cut into chunks, of the length
    that ``chunks`` names for the text's (shortest length, chunk); the last chunk is what remains,
    or joins the one before if too short to be judged. A text fails when chunks outside their limits
    hold more than ``odd_share`` of its bytes. A full chunk of ``chunk`` bytes has ``chunk_band``;
    shorter ones lie between the points of ``short_chunks`` (as ``bands``, and the largest ratio of
    characters of several bytes, which have little room to repeat), by their own length.

    Short texts compress badly (a frame has some bytes of its own, and there is no history), so
    both limits fall with the length. Natural prose reaches 0.33, structured text 0.25 and less,
    so the lower limits lie where only repetition does."""

    level: int = 3
    bands: tuple[tuple[int, float, float], ...] = (
        (128, 0.40, 1.05),
        (256, 0.35, 0.95),
        (512, 0.28, 0.85),
        (1024, 0.25, 0.75),
        (2048, 0.24, 0.70),
        (4096, 0.22, 0.65),
        (8192, 0.20, 0.62),
        (16384, 0.20, 0.60),
        (65536, 0.18, 0.60),
    )
    chunk: int = 4096
    chunk_band: tuple[float, float] = (0.18, 0.62)
    chunks: tuple[tuple[int, int], ...] = ((0, 256), (1024, 512), (4096, 4096))
    short_chunks: tuple[tuple[int, float, float, float], ...] = (
        (128, 0.40, 1.05, 1.07),
        (256, 0.35, 0.93, 1.05),
        (512, 0.28, 0.83, 0.95),
        (1024, 0.25, 0.75, 0.85),
        (2048, 0.24, 0.70, 0.75),
    )
    odd_share: float = 0.25

    def pieces(self, length: int) -> list[tuple[int, int]]:
        """Where each chunk of a text of this length starts and ends."""
        size = [chunk for least, chunk in self.chunks if length >= least][-1]
        starts = [0, *range(size, length - self.bands[0][0] + 1, size)]
        return list(zip(starts, [*starts[1:], length]))

    @cached_property
    def chunk_limits(self) -> np.ndarray:
        points = (*self.short_chunks, (self.chunk, *self.chunk_band, self.chunk_band[1]))
        return np.array(points, float).T

    def odd_chunk(self, chunk: bytes, ratio: float) -> bool:
        if len(chunk) < self.bands[0][0]:
            return False
        sizes, *limits = self.chunk_limits
        at = math.log2(len(chunk))
        least, most, wide = (np.interp(at, np.log2(sizes), limit) for limit in limits)
        if ratio > most and wide > most:
            long_characters = sum(byte >= 0x80 for byte in chunk) / len(chunk)
            most += min(1, 2 * long_characters) * (wide - most)
        return not least <= ratio <= most


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    # The windows' bytes are compared, not a hash of them.
    rows = np.ascontiguousarray(windows).view(f"V{4 * WINDOW}").ravel()
    _, inverse, counts = np.unique(rows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def compression(text: bytes, rules: CompressionBands, squeeze) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their limits, the verdict."""
    if not text:
        return 0.0, 0.0, True
    ratio = len(squeeze(text)) / len(text)
    odd = 0
    for start, end in rules.pieces(len(text)):
        piece = text[start:end]
        odd += len(piece) * rules.odd_chunk(piece, len(squeeze(piece)) / len(piece))
    share = odd / len(text)
    limits = [(least, most) for length, least, most in rules.bands if len(text) >= length]
    inside = not limits or limits[-1][0] <= ratio <= limits[-1][1]
    return ratio, share, inside and share <= rules.odd_share


def judge(doc_id: int | None, text: bytes, rules: CompressionBands, squeeze) -> tuple:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    blank = int(counts[9:14].sum() + counts[32])
    words = text.split()  # of bytes: at 0x20 and 0x09-0x0D alone
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    ratio, odd, inside = compression(text, rules, squeeze)
    return (
        doc_id,
        len(words),
        int(counts.sum() - counts[0x80:0xC0].sum()) - blank,
        int(counts[SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated,
        failed,
        ratio,
        odd,
        not failed and inside,
    )


def quality_rules(docs: DataFrame, rules: CompressionBands = CompressionBands()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no words, so the base rule rejects it; a null doc_id stays null.
    Repeated rows are judged each, an empty table gives an empty one. One text at a time is in
    memory beside its batch, whole, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = [judge(i, t.as_py(), rules, squeeze) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES
            )

    return text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, SCHEMA)


def accepted_documents(
    docs: DataFrame, rules: CompressionBands = CompressionBands()
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    A null or empty text goes; a null doc_id and repeated rows are judged by their text like any
    other; an empty table gives an empty one. Only the texts leave Spark's memory, and a verdict
    comes back; the rows themselves stay where they are."""

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=rules.level).compress
        found = [judge(None, (t.as_py() or "").encode(), rules, squeeze)[-1] for t in texts]
        give_back_memory()
        return pa.array(found, pa.bool_())

    return docs.where(accepted(F.col("text").cast("string")))


TYPES = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
