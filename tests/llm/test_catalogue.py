"""Every query of this subpackage over the smallest tables: against its SQL, and whether it gives a row for each input row."""

import os

import duckdb
import pytest

from strandset.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


COLUMNS = {
    "op1_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_substring_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, con, name):
    found = queries.QUERIES[name](spark, DIR)
    assert COLUMNS[name] <= set(found.columns)
    ids = sorted({r.doc_id for r in found.select("doc_id").collect()})
    assert ids == sorted(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())
    assert found.count() == len(ids) or name == "op2_packing"
