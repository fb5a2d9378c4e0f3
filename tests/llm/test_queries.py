"""The registered queries on the smallest tables: schemas, and the ones SQL can express against DuckDB."""

import os

import duckdb
import pytest

from patchweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op2": "doc_id n_bytes n_tokens over_limit", "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4": "doc_id class_id n_links", "op5": "doc_id start n_tokens ids_crc32", "op6": "doc_id perplexity threshold keep", "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "page_id host path rule verdict", "op9": "doc_id size source_size target taken", "op10": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    want = COLUMNS[name.split("_")[0]].split()
    assert [c for c in df.columns if c in want] == want
    source = "pages" if name.startswith("op8") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    rel = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(flat(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(flat(r[i]) for i in at) for r in rel.fetchall())
