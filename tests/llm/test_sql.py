"""The operators' queries against their DuckDB SQL, where SQL can say them."""

import os

import duckdb
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        at = f"{sf}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    df, rel = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=repr)
