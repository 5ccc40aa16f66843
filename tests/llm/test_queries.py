"""The registered queries: those with SQL against it, the others for their columns."""

import pytest
from check import database, difference

import __spark_entry__ as entry
from gridclim.llm.oracle import ORACLE
from gridclim.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# The columns that each query returns at least.
COLUMNS = {
    "op1": "doc_id n_shingles component_id",
    "op2": "vec_id n_links component_id kept",
    "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6": "doc_id n_lines n_dropped kept_sha256",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "doc_id held_out score predicted",
    "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert {name.split("_")[0] for name in QUERIES} == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(found)
    assert difference(found, database(SF_DIR).execute(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op9_toxicity"}))
def test_one_row_per_row_and_its_columns(spark, name):
    result = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(result.columns)
    table = "embeddings" if "vec_id" in result.columns else "documents"
    rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    if name.startswith("op10_"):
        assert result.select("doc_id").distinct().count() == rows
    else:
        assert result.count() == rows
