"""The registry: every SQL has its query, and results agree with DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from bookflow.jobs import registry

SF = "/root/testdata/sf0.001"
CHOSEN = ["clean_books", "clean_trades", "trade_cleaning_report", "resample_and_align", "return_features", "imbalance_deciles", "tied_quantile_bins", "classification_metrics", "walk_forward_folds", "ols_by_gram"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    want, got = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns, key=lambda c: (want[c].dtype.kind == "f", c))
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["symbol", "decile", "mean", "std", "count"]
