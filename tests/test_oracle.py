"""Every registered query against its DuckDB oracle SQL at sf0.001 (the driver runs the same at sf0.01)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from oracle import all_sql
from orderlens.plans.catalog import REGISTRY
from orderlens.sources.tables import TABLES

from paths import SF_SMALL

SQL = all_sql()
KEYS = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)),
                        key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(KEYS) - set(SQL)
    assert not rows_only, rows_only


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    got = sdf.toPandas()
    rel = con.sql(SQL[key])
    assert {n: SPARK_TO_DUCK.get(t, t) for n, t in sdf.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = rel.df()
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_orders > 0
    assert df.columns == ["total_orders", "units_sold", "gross_revenue", "aov", "unique_skus", "cancellation_rate",
                          "return_rate", "cod_share", "delivered_rate"]
