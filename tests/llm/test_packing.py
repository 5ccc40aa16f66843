"""Packing against the tokenizers library and a plain sum-of-squares loop."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridclim.llm import packing
from gridclim.llm.packing import LENGTH, VOCABULARY, pack_documents, sum_of_squares

from .corpus import odd_rows, table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("packer_rows", [packing.PACKER_ROWS, 10])
def test_each_id_lies_in_one_piece(spark, tokenizer, monkeypatch, packer_rows):
    monkeypatch.setattr(packing, "PACKER_ROWS", packer_rows)
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    rows = list(dict(rows).items())
    pieces = pack_documents(table(spark, rows)).collect()
    sequences = {}
    for piece in pieces:
        sequences.setdefault(piece.sequence_id, []).append(piece)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [
            sum(q.length for q in own[:n]) for n in range(len(own))
        ]
        assert sum(p.length for p in own) <= LENGTH
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        for piece in own:
            part = np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes()
            assert (zlib.crc32(part), piece.doc_tokens) == (piece.ids_crc32, len(ids))
    packers = -(-len(rows) // packer_rows)
    assert sum(sum(p.length for p in own) < LENGTH for own in sequences.values()) <= packers


def test_repeated_and_null_rows(spark):
    rows = [(1, "same words"), (1, "same words"), (None, "no id"), (None, None), (2, "")]
    pieces = pack_documents(table(spark, rows)).collect()
    found = sorted((p.doc_id or 0, p.length) for p in pieces)
    assert found == [(0, 1), (0, 3), (1, 3), (1, 3), (2, 1)]
    assert pack_documents(table(spark, [])).count() == 0


def test_added_tokens_are_ids_of_the_library(spark):
    default = Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"{end}{end}", f"  {end}\n\n{end}  x", f"it's{end}'s", f"<{end}>", end[:-1]]
    texts += [f"one \t{end} two" * 400, "\x1c\x85  ok <|endoftext|> it's", "<|endoftext |>"]
    pieces = pack_documents(table(spark, list(enumerate(texts)))).collect()
    for doc_id, text in enumerate(texts):
        ids = default.encode(text, add_special_tokens=False).ids + [0]
        own = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in own) == len(ids)
        for piece in own:
            part = np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes()
            assert (zlib.crc32(part), piece.doc_tokens) == (piece.ids_crc32, len(ids))


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\u3000"])
def test_long_blanks(spark, tokenizer, blank):
    """Runs of blanks that the faster library gives up at, alone and around words."""
    run = blank * 1_000_000
    texts = [run, f"a{run}b", f"{run}<|endoftext|>{run[:70_000]} c", blank * 49_999 + "d"]
    pieces = pack_documents(table(spark, list(enumerate(texts)))).collect()
    for doc_id, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        for piece in own:
            part = np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes()
            assert (zlib.crc32(part), piece.doc_tokens) == (piece.ids_crc32, len(ids))


def test_few_ids_are_cut(monkeypatch):
    """Of lengths like those of a corpus, sum-of-squares places most."""
    rng = np.random.default_rng(1)
    lengths = rng.lognormal(6.4, 0.8, packing.PACKER_ROWS).astype(int) % LENGTH
    lengths = lengths[lengths > 0]
    bins, _ = sum_of_squares(lengths)
    fill = np.bincount(bins, lengths)
    assert fill[fill < LENGTH].sum() < 0.1 * lengths.sum()


def plain(lengths, capacity):
    """Tries every place and recounts the sum of squares."""
    levels, chosen, offsets = [], [], []
    for length in lengths:
        best = None
        options = {fill: n for n, fill in enumerate(levels) if fill + length <= capacity and fill}
        for fill, n in [*options.items(), (0, None)]:
            after = list(levels)
            if n is None:
                after.append(length)
            else:
                after[n] += length
            counts = np.bincount([f for f in after if f < capacity], minlength=1)
            cost = int((counts.astype(int) ** 2).sum())
            if best is None or (cost, -fill) < best[:2]:
                best = (cost, -fill, n, after)
        levels = best[3]
        chosen.append(best[2])
        offsets.append(-best[1])
    return offsets, sorted(levels)


def test_sum_of_squares_rule():
    rng = random.Random(2)
    lengths = [rng.choice([1, 2, 3, 5, 7, 8, 10]) for _ in range(150)]
    bins, offsets = sum_of_squares(np.array(lengths), 10)
    wanted, levels = plain(lengths, 10)
    assert offsets.tolist() == wanted
    assert sorted(np.bincount(bins, lengths).astype(int).tolist()) == levels
