"""The operators' queries against their SQL in DuckDB."""

import duckdb
import pytest

from marketlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, data)
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in cur.fetchall())
