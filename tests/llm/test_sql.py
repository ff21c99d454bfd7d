import duckdb
import pytest

from orderlens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(SQL[key])
    got = QUERIES[key](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    want = sorted(rel.df()[cols].itertuples(index=False, name=None), key=str)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == want


def test_every_operator_has_one_query():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14))
