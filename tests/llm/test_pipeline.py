"""The pipeline's stages on a small table, each against its operator's rule."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry

from tokenizers import Tokenizer

from gridclim.llm.packing import VOCABULARY

from .corpus import odd_rows, table, words
import random

from .test_lines import expected as lines_expected
from .test_ngram_join import expected as groups_expected
from .test_suffix import expected as passages_expected


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    extra = [(500 + n, "\n".join(" ".join(words(rng, 30)) for _ in range(3))) for n in range(8)]
    extra += [(510 + n, extra[0][1] + "\n" + extra[1][1].split("\n")[0]) for n in range(2)]
    return table(spark, odd_rows() + extra)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_rules", "line_dedup", "ngram_jaccard", "suffix_dedup", "packing"
    ]
    kept = stages["quality_rules"](spark, docs, "")
    assert kept.columns == docs.columns
    before = rows_of(kept)
    assert {500, 501, 510} <= {i for i, _ in before} and 1 not in {i for i, _ in before}

    deduped = stages["line_dedup"](spark, kept, "")
    assert deduped.columns == docs.columns
    wanted = lines_expected(before)
    after = rows_of(deduped)
    assert sorted(after, key=repr) == sorted(
        ((i, wanted[i, t][2]) for i, t in before), key=repr
    )
    assert all(r.n_chars == len(r.text) for r in deduped.collect())

    single = stages["ngram_jaccard"](spark, deduped, "")
    groups = groups_expected(after)
    left = rows_of(single)
    assert sorted(left, key=repr) == sorted(
        ((i, t) for i, t in after if i is None or groups[i][1] == i), key=repr
    )

    unique = stages["suffix_dedup"](spark, single, "")
    assert unique.columns == docs.columns
    wanted = passages_expected(left)
    texts = rows_of(unique)
    assert sorted(texts, key=repr) == sorted(
        ((i, wanted[i, t][3].decode("utf-8", "ignore")) for i, t in left), key=repr
    )

    pieces = stages["packing"](spark, unique, "").collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in texts}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    wanted = sorted(
        len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts
    )
    starts = [p for p in pieces if p.start == 0]
    assert sorted(p.doc_tokens for p in starts) == wanted
    assert sum(p.length for p in pieces) == sum(wanted)


def test_run_and_registration(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    fill = {}
    for piece in pieces:
        fill[piece.sequence_id] = fill.get(piece.sequence_id, 0) + piece.length
    assert pieces and max(fill.values()) <= 1024
    numbers = {name[2:].split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert numbers == {str(n) for n in range(1, 14)}
