"""Every registered relational query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tarnwell.plans import driver, inventory  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    def cell(v):
        return None if pd.isna(v) else int(v) if isinstance(v, (float, np.integer)) and v == int(v) else bool(v) if isinstance(v, np.bool_) else v

    return sorted(([cell(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_equals_sql(spark, sql, name):
    found, wanted = driver.QUERIES[name](spark, SF).toPandas(), sql.sql(driver.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(driver.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["o_orderkey", "o_custkey"]
