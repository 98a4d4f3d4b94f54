"""Queries with SQL equal it; all queries return their contract's columns."""

import pytest

from comparison import differences
from tiffin.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_token_counts": "doc_id n_tokens",
    "op2_quality": "doc_id held_out score predicted",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op5_winnowing": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_near_duplicates": "doc_id n_shingles component_id kept",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_neighbours": "query_id rank vec_id score",
    "op11_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    assert df.count() > 0


def test_every_operator_has_one_query():
    assert set(queries.QUERIES) == {*COLUMNS, "pipeline"}
