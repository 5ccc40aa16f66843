"""Byte-level BPE against the tiktoken library, and decoding back to the text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridclim.llm import bpe
from gridclim.llm.bpe import VOCABULARY, Encoder, Vocabulary, encode_and_decode

from .corpus import odd_rows, table


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(VOCABULARY)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={}
    )


def ids(encoder, text):
    return np.frombuffer(next(encoder.encode([text])), "<u4").tolist()


def test_ids_and_round_trip(vocabulary, library):
    rng = random.Random(5)
    texts = [t or "" for _, t in odd_rows()]
    texts += ["aaaa" * 700, "abab" * 300, "it's I'LL 12345 \n\n  x", "\x00\x1c\x85 　y"]
    codes = [c for c in range(0x2FFF) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(rng.choice(codes)) for _ in range(80)) for _ in range(150)]
    encoder = Encoder(vocabulary)
    for text in texts:
        own = ids(encoder, text)
        assert own == library.encode_ordinary(text)
        assert vocabulary.decode(own) == text.encode()


def test_small_blocks_and_forgetting_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 30)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 100)
    encoder = Encoder(vocabulary)
    for _, text in odd_rows()[:25]:
        text = (text or "")[:3000]
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_query_columns(spark, library):
    rows = odd_rows()
    result = encode_and_decode(table(spark, rows)).collect()
    assert len(result) == len(rows)
    texts = dict(rows)
    for row in result:
        if row.doc_id is None:
            continue
        coded = np.array(library.encode_ordinary(texts[row.doc_id] or ""), "<u4")
        assert row.n_tokens == len(coded)
        assert row.ids_sha256 == hashlib.sha256(coded.tobytes()).hexdigest()
        plain = (texts[row.doc_id] or "").encode()
        assert row.decoded_sha256 == hashlib.sha256(plain).hexdigest()
    assert encode_and_decode(table(spark, [])).count() == 0
