"""Every query that SQL can express against DuckDB, over the same tables."""

import duckdb
import pandas as pd
import pytest

from genorigin.queries import QUERIES
from genorigin.sql import ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, con, name):
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=0, atol=1.01e-6)


def test_every_query_is_known(spark):
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["run", "sampleid", "role", "x", "y"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
