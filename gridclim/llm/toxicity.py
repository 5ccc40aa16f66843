"""Toxicity scores from subword bags.

A word is the bag of its character n-grams (of UTF-8 bytes, with marks at both ends). The n-grams'
vectors, hashed to a fixed number of buckets, are averaged over a window of neighbouring words and
enter a linear softmax. Vectors and softmax are trained together. A text scores as its most toxic
window, so a few words are not lost in a long text. Misspellings that training never saw share
most n-grams with the words it saw."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mix, text_bytes

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Score from which a text counts as toxic.
TOXIC_FROM = 0.7
EDGES = b".,;:!?\"'()[]{}<>*#"
#: Distinct words that a task remembers with their logits; then it starts anew.
REMEMBERED_WORDS = 200_000
#: Bytes of text whose words are held at a time; one text is never cut.
RUN_BYTES = 2_000_000


@dataclass(frozen=True)
class Training:
    """``rows_per_class`` bounds the sample: so many labelled rows of each class, those with the
    smallest hash of doc_id, but for texts of more than ``text_bytes`` bytes (which are left out,
    not cut). All else follows from the sample."""

    rows_per_class: int = 2000
    text_bytes: int = 20_000
    lengths: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 16
    dimensions: int = 8
    window: int = 3
    epochs: int = 50
    rate: float = 0.4
    dropped: float = 0.5
    decay: float = 1e-4
    seed: int = 7


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case; a word that follows itself counts once, so that a window holds
    neighbours and not copies."""
    return [word for word, _ in groupby(text.lower().split())]


def ngram_buckets(words: list[bytes], t: Training) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of each word, in order of words. The shortest n-gram length
    is no longer than the shortest word with its two marks, so every word has one."""
    marked = [b"<" + (word.strip(EDGES) or word) + b">" for word in words]
    lengths = np.array([len(word) for word in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, buckets = [], []
    for n in t.lengths:
        spans = len(data) - n + 1
        if spans <= 0:
            continue
        value = np.full(spans, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x100000001B3) + data[j : j + spans] + np.uint64(1)
        whole = owner[:spans] == owner[n - 1 :]
        owners.append(owner[:spans][whole])
        buckets.append((mix(value[whole]) % np.uint64(t.buckets)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def window_means(logits: np.ndarray, window: int) -> np.ndarray:
    """Mean over each window of neighbouring words, or over all words if they are fewer."""
    size = min(window, len(logits))
    sums = np.cumsum(np.concatenate([[0.0], logits]))
    return (sums[size:] - sums[:-size]) / size


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, t: Training) -> tuple[np.ndarray, float]:
    """The logit of each bucket, and the bias. In two classes the softmax is a logistic function of
    the difference of the class weights; the product of bucket vectors and weights is all that
    scoring needs."""
    known: dict[bytes, int] = {}
    docs = [
        np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64)
        for text in texts
    ]
    filled = np.array([len(doc) > 0 for doc in docs], bool)
    if not known:
        return np.zeros(t.buckets), -4.0
    owner, bucket = ngram_buckets(list(known), t)
    counts = np.bincount(owner, minlength=len(known))
    first = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(t.seed)
    vectors = rng.normal(0, 0.1, (t.buckets, t.dimensions))
    weights = rng.normal(0, 0.1, t.dimensions)
    bias = 0.0
    scale = [np.full_like(vectors, 1e-8), np.full_like(weights, 1e-8), 1e-8]
    docs = [doc for doc in docs if len(doc)]
    target = labels[filled].astype(float)
    # Both classes weigh alike.
    toxic = min(max(target.mean(), 1e-9), 1 - 1e-9) if len(target) else 0.5
    share = np.where(target > 0, 0.5 / toxic, 0.5 / (1 - toxic))
    for _ in range(t.epochs):
        logit = np.bincount(owner, (vectors @ weights)[bucket], len(known)) / counts
        # The most toxic window of each text, and the n-grams in it but for some left out.
        windows = []
        for doc in docs:
            means = window_means(logit[doc], t.window)
            at = int(np.argmax(means))
            windows.append(doc[at : at + t.window])
        size = np.array([len(w) for w in windows])
        word = np.concatenate(windows)
        doc_of = np.repeat(np.arange(len(docs)), size)
        spans = counts[word]
        gram_doc = np.repeat(doc_of, spans)
        offsets = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        gram = bucket[np.repeat(first[word], spans) + offsets]
        part = (rng.random(len(gram)) >= t.dropped) / np.repeat(spans * size[doc_of], spans)
        part /= 1 - t.dropped
        means = np.stack([
            np.bincount(gram_doc, part * vectors[gram, d], len(docs)) for d in range(t.dimensions)
        ], axis=1)
        error = (sigmoid(means @ weights + bias) - target) * share / len(docs)
        by_gram = error[gram_doc] * part
        decay = t.decay / len(docs)
        slope = np.bincount(gram, by_gram, t.buckets)[:, None] * weights + decay * vectors
        slopes = [slope, error @ means + decay * weights, float(error.sum())]
        for i, value in enumerate(slopes):
            scale[i] = scale[i] + value * value
        vectors -= t.rate * slopes[0] / np.sqrt(scale[0])
        weights -= t.rate * slopes[1] / np.sqrt(scale[1])
        bias -= t.rate * slopes[2] / np.sqrt(scale[2])
    return vectors @ weights, float(bias)


class Scorer:
    def __init__(self, buckets: np.ndarray, bias: float, t: Training):
        self.buckets, self.bias, self.training = buckets, bias, t
        self.known: dict[bytes, float] = {}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The texts' scores, a run of some texts at a time."""
        parts, run, size = [np.zeros(0)], [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= RUN_BYTES:
                parts.append(self._scores(run))
                run, size = [], 0
        return np.concatenate([*parts, self._scores(run)])

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        words = [words_of(text) for text in texts]
        new = list(set().union(*words) - self.known.keys()) if words else []
        if new:
            owner, bucket = ngram_buckets(new, self.training)
            sums = np.bincount(owner, self.buckets[bucket], len(new))
            means = sums / np.bincount(owner, minlength=len(new))
            self.known.update(zip(new, means.tolist()))
        get = self.known.__getitem__
        logits = (np.fromiter(map(get, own), float, len(own)) for own in words)
        most = [
            window_means(x, self.training.window).max() if len(x) else 0.0 for x in logits
        ]
        return sigmoid(np.array(most, float) + self.bias)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, t: Training) -> pd.DataFrame:
    """(text, toxic) of at most ``rows_per_class`` rows of each class. Ids choose, nothing else;
    they are few, so the texts are met where they are read."""
    doc_id = F.col("doc_id")
    marked = (
        labels.select(
            doc_id.cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
        )
        .where(doc_id.isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(doc_id))
        .dropDuplicates(["doc_id"])
        .withColumn("place", F.xxhash64("doc_id"))
    )
    ids = [
        marked.where(F.col("toxic") == label).orderBy("place", "doc_id").limit(t.rows_per_class)
        for label in (0, 1)
    ]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    rows = text_bytes(docs, doc_id.cast("long").alias("doc_id"))
    short = rows.where(F.length("text") <= t.text_bytes).join(chosen, "doc_id")
    # A doc_id that comes again cannot widen the sample.
    least = short.orderBy("place", "doc_id", "text").limit(2 * t.rows_per_class)
    return least.select("text", "toxic").toPandas()


def score_toxicity(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), trained on ``labels`` (doc_id, toxic).

    Only text enters a score. A null or empty text has no window and gets the score of the bias
    alone. A null doc_id is not held out; labels without doc_id or toxic are not used. Repeated
    rows score alike. With no labelled rows every score is low. An empty table gives an empty one.
    The sample, bounded by ``Training``, is the only thing that reaches the driver."""
    sample = training_sample(docs, labels, t)
    model = train(list(map(bytes, sample["text"])), sample["toxic"].to_numpy(), t)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, t)
        for batch in batches:
            scores = scorer.scores([text.as_py() for text in batch.column(2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= TOXIC_FROM).astype(np.int32), pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)
