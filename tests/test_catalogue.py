"""Every registered query of k-mer sets against its SQL over the smallest tables."""

import os

import duckdb
import pytest

from strandset.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_codes_of_more_than_eight_bases(spark, con, tmp_path):
    con.execute(f"COPY (SELECT * REPLACE (l_partkey + 65530 AS l_partkey) FROM lineitem) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    for name in ("decode_all", "view_kmer_code", "dump_canonical_only"):
        got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(own.execute(catalogue.ORACLE_SQL[name]).fetchall()) and got
