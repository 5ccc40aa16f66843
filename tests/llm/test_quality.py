"""Quality rules against plain counting."""

import base64
import random
from pathlib import Path
from pydoc_data.topics import topics

import pytest
import zstandard

from gridclim.llm.quality import (
    CompressionBands,
    accepted_documents,
    compression,
    judge,
    quality_rules,
)

from .corpus import odd_rows, table

BLANKS = " \t\n\x0b\x0c\r"


def counted(text):
    """The base columns, counted one character and one window at a time."""
    text = text or ""
    for blank in BLANKS:
        text = text.replace(blank, " " if blank != "\n" else "\n")
    tokens = text.replace("\n", " ").split(" ")
    tokens = [t for t in tokens if t]
    windows = [tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)]
    places = {}
    for at, window in enumerate(windows):
        places.setdefault(window, []).append(at)
    repeated = {at + j for ats in places.values() if len(ats) > 1 for at in ats for j in range(8)}
    return (
        len(tokens), sum(map(len, tokens)), sum(text.count(c) for c in "#*$%&|<>"), len(repeated)
    )


def duplicate_lines(text):
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


def test_base_counts_and_verdict(spark):
    rows = odd_rows() + [(80, "# * same line\n# * same line\n\n\n" + "u v w x y z " * 9)]
    result = quality_rules(table(spark, rows)).collect()
    assert len(result) == len(rows)
    texts = dict(rows)
    for row in result:
        if row.doc_id is None:
            continue
        n_words, chars, symbols, repeated = counted(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_repeat_words) == (
            n_words, chars, symbols, repeated
        ), row
        assert row.n_dup_lines == duplicate_lines(texts[row.doc_id])
        assert row.base_failed == (n_words < 20 or 100 * repeated > 30 * n_words)
        assert not (row.base_failed and row.kept)


def test_bands_reject_repetitive_and_incompressible_text():
    rules, squeeze = CompressionBands(), zstandard.ZstdCompressor(level=3).compress
    import random

    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(6000))
    prose = " ".join(
        "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(1200)
    ).encode()
    assert not compression(b"again and again " * 400, rules, squeeze)[2]
    assert not compression(noise, rules, squeeze)[2]
    assert compression(prose, rules, squeeze)[2]
    # One chunk of many may be odd, half of them may not.
    assert not compression(prose[:8192] + b"a" * 8192, rules, squeeze)[2]


def test_accepted_documents_keep_all_columns(spark):
    docs = table(spark, odd_rows())
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    accepted = accepted_documents(docs)
    assert accepted.schema == docs.schema
    assert {r.doc_id for r in accepted.collect()} == kept


@pytest.mark.parametrize("run", [quality_rules, accepted_documents])
def test_empty_table(spark, run):
    assert run(table(spark, [])).count() == 0


def test_real_prose_is_kept():
    rules, squeeze = CompressionBands(), zstandard.ZstdCompressor(level=3).compress
    texts = {name: text.encode() for name, text in topics.items()}
    texts |= {p.name: p.read_bytes() for p in Path("/usr/share/common-licenses").glob("*")}
    judged = {name: judge(None, text, rules, squeeze) for name, text in texts.items()}
    passed = {name: row for name, row in judged.items() if not row[6] and len(texts[name]) > 4000}
    assert len(passed) > 20
    assert [name for name, row in passed.items() if not row[-1]] == []
    # Half of a text that is one passage over and over is still too much.
    prose = texts["specialnames"][:8192]
    assert judge(None, prose, rules, squeeze)[-1]
    assert not compression(prose + prose[:300] * 28, rules, squeeze)[2]


@pytest.mark.parametrize("clean, junk", [(8192, 4090), (4096, 2500), (1800, 1200), (900, 500)])
def test_tails_and_short_texts_are_judged_in_chunks(clean, junk):
    rules, squeeze = CompressionBands(), zstandard.ZstdCompressor(level=3).compress
    prose = topics["specialnames"].encode()
    noise = base64.b64encode(random.Random(4).randbytes(junk))[:junk]
    assert compression(prose[: clean + junk], rules, squeeze)[1:] == (0, True)
    for text in (prose[:clean] + noise, prose[:clean] + prose[:20] * (junk // 20)):
        _, odd, kept = compression(text, rules, squeeze)
        assert odd > rules.odd_share and not kept
    # All bytes lie in one chunk each.
    for length in (1, 127, 128, 300, 383, 384, 1024, 4095, 4096, 4223, 4224, 12282):
        pieces = rules.pieces(length)
        assert [0, *(end for _, end in pieces)] == [*(start for start, _ in pieces), length]
