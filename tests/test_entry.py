"""Driver contract and a few queries against their DuckDB oracles on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.sources.testdata import BASE_TABLES
from tools.check_oracle import _norm

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "vendor_name" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


@pytest.mark.parametrize("name", ["k09_vendor_relationships", "j08_advanced_dedup", "p01_standardize_date",
                                  "b06_b11_account_metrics", "r16_all_flags", "c10_categorize_enhanced"])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    s = entry.queries()[name](spark, SF)
    got = sorted(tuple(_norm(r[c]) for c in sorted(s.columns)) for r in s.collect())
    o = con.execute(entry.oracle_sql()[name]).fetchdf()
    o = o.astype(object).where(o.notna(), None)
    exp = sorted(tuple(_norm(r[c]) for c in sorted(o.columns)) for r in o.to_dict("records"))
    assert sorted(s.columns) == sorted(o.columns)
    assert got == exp
