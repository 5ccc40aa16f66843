"""Byte-level BPE by replaying the merges over the words of a block of texts.

The distinct words of a block lie behind each other as a linked list of tokens. An inverted index
holds, for each rank, the positions where a pair of tokens with this rank stands. Ranks are taken
in order; merging a pair touches its two neighbours alone, whose new pairs enter the index."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words that a task remembers with their ids; then it starts anew.
REMEMBERED_BYTES = 64_000_000
#: Bytes of new words whose merges are replayed together.
BLOCK_BYTES = 1_000_000
#: A pair of ids as one number: the left one is shifted by so many bits.
SHIFT = 24


class Vocabulary:
    """Ranks of a vocabulary: bytes to id, id to bytes, and pair of ids to id of the merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        # Stands after each word in the linked list; no token has this id.
        self.end = len(self.tokens)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            entries = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in entries})

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        known = [self.ids.get(word) for word in words]
        rest = [word for word, whole in zip(words, known) if whole is None]
        replayed = iter(self._replay(rest))
        return [
            np.array([whole], "<u4") if whole is not None else next(replayed) for whole in known
        ]

    def _replay(self, words: list[bytes]) -> list[np.ndarray]:
        if not words:
            return []
        single = np.array([self.ids.get(bytes([b]), self.end) for b in range(256)], np.int64)
        lengths = np.array([len(word) for word in words])
        # One cell for each byte and one for the end of each word.
        ends = np.cumsum(lengths + 1) - 1
        cells = np.full(ends[-1] + 1, self.end, np.int64)
        inside = np.ones(len(cells), bool)
        inside[ends] = False
        cells[inside] = single[np.frombuffer(b"".join(words), np.uint8)]
        merged, following = self._merge_all(cells)
        # A merged pair lives on in its left cell; the right one is marked by following = 0.
        alive = inside & (following != 0)
        counts = np.add.reduceat(alive, np.concatenate([[0], ends[:-1] + 1]))
        return np.split(merged[alive].astype("<u4"), np.cumsum(counts)[:-1])

    def _merge_all(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells after all merges, and the linked list that tells which are left."""
        rank_of = self.pairs.get
        index: dict[int, list[int]] = {}
        for at, pair in enumerate(((cells[:-1] << SHIFT) | cells[1:]).tolist()):
            rank = rank_of(pair)
            if rank is not None:
                if rank in index:
                    index[rank].append(at)
                else:
                    index[rank] = [at]
        cell = cells.tolist()
        following = list(range(1, len(cell) + 1))
        previous = list(range(-1, len(cell) - 1))
        waiting = list(index)
        heapq.heapify(waiting)
        while waiting:
            rank = heapq.heappop(waiting)
            # In order of position, so that of overlapping pairs the left one is merged.
            for at in sorted(index.pop(rank)):
                after = following[at]
                if not after or rank_of((cell[at] << SHIFT) | cell[after]) != rank:
                    continue  # a neighbour was merged meanwhile
                beyond, before = following[after], previous[at]
                cell[at], following[at], following[after], previous[beyond] = rank, beyond, 0, at
                # The cell before the first word is the end of the last one.
                new = rank_of((cell[before] << SHIFT) | rank)
                if new is not None:
                    if new in index:
                        index[new].append(before)
                    else:
                        index[new] = [before]
                        heapq.heappush(waiting, new)
                new = rank_of((rank << SHIFT) | cell[beyond])
                if new is not None:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(waiting, new)
        return np.array(cell), np.array(following)


class Encoder:
    """Encodes texts; remembers the ids of words up to a bound of memory."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        block, size = [], 0
        for word in words:
            block.append(word)
            size += len(word)
            if size >= BLOCK_BYTES:
                self._learn_block(block)
                block, size = [], 0
        self._learn_block(block)

    def _learn_block(self, words: list[str]) -> None:
        coded = self.vocabulary.encode_words([word.encode() for word in words])
        for word, ids in zip(words, coded):
            self.known[word] = ids.tobytes()
            self.held += len(word) + 4 * len(ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        words = [self.split(text) for text in texts]
        self.learn(set().union(*words) - self.known.keys())
        for own in words:
            yield b"".join(map(self.known.__getitem__, own))


def blocks(texts: list[str], most: int = 4 * BLOCK_BYTES) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; one text is never cut."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield slice(start, at + 1)
            start, size = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_and_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): the number of tokens,
    and digests of the ids and of the decoded bytes.

    A null text is an empty one: no tokens, and the digests of nothing. A null doc_id stays null,
    repeated rows give repeated rows, an empty table an empty one. The driver reads the vocabulary
    and hands it to the tasks; its size does not depend on the data."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for block in blocks(texts):
                for ids in encoder.encode(texts[block]):
                    decoded = vocabulary.value.decode(np.frombuffer(ids, "<u4").tolist())
                    rows.append((
                        len(ids) // 4,
                        hashlib.sha256(ids).hexdigest(),
                        hashlib.sha256(decoded).hexdigest(),
                    ))
            counts, coded, plain = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(plain, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, SCHEMA)
