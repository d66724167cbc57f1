"""Every query of the fact engine against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from factloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    text = lambda x: "null" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    out = pd.DataFrame({c: frame[c].map(text) for c in columns}, columns=columns)
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query(name, spark, duck):
    query, oracle = queries.REGISTRY[name]
    found = plain(query(queries.Facts(spark, SF)).toPandas())
    if oracle:
        expected = plain(duck.sql(oracle).df())
        assert list(found.columns) == list(expected.columns)
        pd.testing.assert_frame_equal(found, expected, check_dtype=False, check_index_type=False, check_column_type=False)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = Path(queries.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "factloom.llm" not in path.read_text(), path
