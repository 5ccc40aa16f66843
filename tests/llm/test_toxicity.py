"""Held-out accuracy of the toxicity scores, also for misspellings that training never saw."""

import random
import zlib

import numpy as np

from gridclim.llm.toxicity import Training, ngram_buckets, score_toxicity, train, window_means

from .corpus import odd_rows, table, words

INSULTS = ["blockhead", "nitwitted", "scoundrel", "dunderhead", "ignoramus", "troglodyte"]
SMALL = Training(rows_per_class=150, epochs=40, buckets=1 << 14)


def misspelt(rng, word):
    at = rng.randrange(1, len(word) - 1)
    return word[:at] + rng.choice("0134xz") + word[at + 1 :]


def corpus(n=360):
    rng = random.Random(3)
    rows, labels, seen = [], [], set()
    for doc_id in range(n):
        toxic = doc_id % 3 == 0
        own = words(rng, rng.randrange(8, 60))
        held = zlib.crc32(str(doc_id).encode()) % 3 == 1
        for _ in range(2 if toxic else 0):
            word = rng.choice(INSULTS)
            if held:  # only here
                word = misspelt(rng, word)
            else:
                seen.add(word)
            own.insert(rng.randrange(len(own)), word)
        rows.append((doc_id, " ".join(own)))
        labels.append((doc_id, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    marked = spark.createDataFrame(
        labels + [(None, 1, 1), (5, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int"
    )
    everything = rows + [(i + 10_000 if i is not None else None, t) for i, t in odd_rows()]
    result = score_toxicity(table(spark, everything), marked, SMALL).collect()
    assert len(result) == len(everything)
    toxic = {doc_id: label for doc_id, _, label in labels}
    right = []
    for row in result:
        held = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 1
        assert row.held_out == held and 0 <= row.score <= 1
        assert row.predicted == (row.score >= 0.7)
        if held and row.doc_id in toxic:
            right.append(row.predicted == toxic[row.doc_id])
    assert len(right) > 80 and np.mean(right) > 0.9


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    result = score_toxicity(table(spark, odd_rows()), none, SMALL).collect()
    assert {r.predicted for r in result} == {0}
    assert score_toxicity(table(spark, []), none, SMALL).count() == 0


def test_same_sample_same_model():
    texts = [b"one two blockhead", b"three four five", b"six nitwitted seven", b"eight nine"]
    first, again = (train(texts, np.array([1, 0, 1, 0]), SMALL) for _ in range(2))
    assert (first[0] == again[0]).all() and first[1] == again[1]


def test_ngrams_and_windows():
    owner, _ = ngram_buckets([b"a", b"long"], Training())
    # <a> has 2 + 1 n-grams of two, three and four bytes; <long> has 5 + 4 + 3.
    assert np.bincount(owner).tolist() == [3, 12]
    assert window_means(np.array([1.0, 3.0]), 4).tolist() == [2.0]
    assert window_means(np.array([1.0, 3.0, 5.0]), 2).tolist() == [2.0, 4.0]
