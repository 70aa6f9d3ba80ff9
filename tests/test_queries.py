"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from terrachron.plans import catalogue, formats, shapes, workload  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    if name in catalogue.oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(f"{FOLDER}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want = con.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(want) == rows(got)
    else:
        assert len(got)
    assert len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
