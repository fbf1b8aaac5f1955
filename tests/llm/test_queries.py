"""Every query of the subpackage runs, and equals its SQL where it has one."""

import duckdb
import pytest

import check
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for name_of_table in ("documents", "embeddings"):
        con.execute(f"create view {name_of_table} as select * from '{sf}/{name_of_table}.parquet'")
    assert check.compare(df, con.sql(queries.ORACLES[name])) is None


def test_one_query_for_each_operator():
    assert {q.split("_")[0] for q in queries.QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
