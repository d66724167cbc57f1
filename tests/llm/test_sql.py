"""Every training-data query that has SQL, against it in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from factloom.llm import queries
from tests.test_oracle import TABLES, plain

pytestmark = pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark):
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as duck:
        for t in TABLES:
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        expected = plain(duck.sql(queries.oracle_sql()[name]).df())
    found = plain(queries.queries()[name](spark, sf).toPandas())
    pd.testing.assert_frame_equal(found, expected, check_dtype=False)
