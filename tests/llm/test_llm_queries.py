"""Every query of the subpackage over the smallest tables: its SQL where it has one, its columns and one row for each document."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from oracle import plain, rows_of

from veriloom.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()
# The columns that each query returns at least.
COLUMNS = {
    "op1": "doc_id fingerprint component_id",
    "op2": "doc_id size text_crc32 law shard slot grown_shard",
    "op3": "doc_id keep_id group_size kept text_sha256",
    "op4": "doc_id held_out score predicted",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id size source_size target taken",
    "pipeline": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    rows = df.collect()
    if name in SQL:
        columns, want = rows_of(SQL[name], sf)
        assert sorted(df.columns) == columns
        assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == want
    if name == "op7_schema_chat":
        assert sorted(r["conv_id"] for r in rows) == [-1, *sorted(r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect())]
    elif name != "pipeline":
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
