import duckdb
import pytest

from tabsieve.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(out.fetchall())
