"""Token alignment against the tokenizer libraries and a plain count of all links."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridclim.llm import alignment
from gridclim.llm.alignment import BYTE_LEVEL, PIECES, align_tokens, common_ends, matched_ends
from gridclim.llm.byte_level import read_vocabulary
from gridclim.llm.queries import op12_token_alignment

from .corpus import odd_rows, table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain_groups():
    """Text to its groups [(ids, ids), ...], by the libraries themselves."""
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    token = {rank: content for content, rank in read_vocabulary(BYTE_LEVEL)[0].items()}

    def piece(n):
        name = second.id_to_piece(n)
        return bytes([int(name[3:-1], 16)]) if second.is_byte(n) else name.replace("▁", " ").encode()

    def cut(text):
        if not text:
            return []
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(token.get, a)) != whole or b"".join(map(piece, b)) != whole:
            return []
        ends_a = np.cumsum([len(token[n]) for n in a]).tolist()
        ends_b = np.cumsum([len(piece(n)) for n in b]).tolist()
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append((a[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        return groups

    return cut


def expected(rows, cut):
    """The columns of the operator for each row."""
    groups = [cut(text) for _, text in rows]
    links = [[(x, y) for a, b in own for x in a for y in b] for own in groups]
    count = Counter(pair for own in links for pair in set(own))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    found = []
    for (doc_id, _), own, pairs in zip(rows, groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        found.append((
            doc_id, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own),
            len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs),
            text,
        ))
    return found


ODD = [
    (100, " two  blanks   and more    "), (101, "▁ is a blank to one"), (102, "a\x00b"),
    (103, "<0x41> <|endoftext|> <s> </s> <unk>"), (104, "日本語のテキスト、区切りなし。" * 20),
    (105, "\n\n\t \r\n x"), (106, "naïve ﬁ № é   　 𝔘𝔫𝔦 👩‍👩‍👧"), (107, "9" * 400),
    (108, "=" * 300 + "ab" * 200), (109, " "), (110, "x"), (111, "ß" * 1500),
]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 300])
def test_as_the_libraries_and_all_links(spark, plain_groups, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(alignment, "LISTED_LINKS", 1024 if block_bytes > 300 else 5)
    rows = [(i, t) for i, t in odd_rows() if t is None or len(t) < 10_000] + ODD
    found = [
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.aligned.decode())
        for r in align_tokens(table(spark, rows)).collect()
    ]
    order = repr
    assert sorted(found, key=order) == sorted(expected(rows, plain_groups), key=order)


def test_long_blanks_and_long_words(spark, plain_groups):
    rows = [(1, " " * 120_000), (2, "a" + "\t" * 120_000 + "b"), (3, "\n" * 60_000 + " x" * 10)]
    rows += [(4, "y" * 50_000)]
    found = {r.doc_id: r for r in align_tokens(table(spark, rows), digest=True).collect()}
    for want in expected(rows, plain_groups):
        row = found[want[0]]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == want[1:5]
        assert (row.n_best, row.count_sum) == want[5:7]
        assert row.aligned.decode() == hashlib.sha256(want[7].encode()).hexdigest()


def test_an_empty_table(spark):
    assert align_tokens(table(spark, [])).count() == 0
    [row] = align_tokens(table(spark, [(None, None)])).collect()
    assert tuple(row) == (None, 0, 0, 0, 0, 0, 0, b"")


def test_the_query(spark, plain_groups):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    wanted = {
        row[0]: (*row[1:7], hashlib.sha256(row[7].encode()).hexdigest() if row[7] else "")
        for row in expected(rows, plain_groups)
    }
    found = {
        r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in op12_token_alignment(spark, SF_DIR).collect()
    }
    assert found == wanted


def test_common_ends_of_random_lists():
    rng = random.Random(3)
    lists_a, lists_b, base = [], [], 0
    for _ in range(200):
        length = rng.choice([1, 2, 30, 3000])
        ends = [
            sorted({*rng.sample(range(1, length + 1), rng.randrange(0, length + 1)), length})
            for _ in range(2)
        ]
        lists_a.append([base + end for end in ends[0]])
        lists_b.append([base + end for end in ends[1]])
        base += length
    a, b = np.concatenate(lists_a), np.concatenate(lists_b)
    places_a, places_b = matched_ends(
        a, b, np.array(list(map(len, lists_a))), np.array(list(map(len, lists_b)))
    )
    assert a[places_a].tolist() == b[places_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    first, last = np.zeros(len(a), np.int64), np.full(len(a), len(b) - 1)
    common, place = common_ends(a, b, first, last)
    assert common.tolist() == places_a.tolist() and place.tolist() == places_b.tolist()
