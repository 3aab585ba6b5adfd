"""Every query of the plans against its SQL in DuckDB."""

import duckdb
import pytest

from marketlens.plans import catalogue, dashboards, exchange, files, finding, imports, listings, people, places, scraped, shops, shown, texts, upkeep
from marketlens.streaming import unread, views

PLANS = [(m, n) for m in (catalogue, shops, dashboards, finding, people, places, files, imports, listings, scraped, exchange, texts, upkeep, shown, views, unread) for n in m.QUERIES]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    return (v is None, repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))


@pytest.mark.parametrize("module,name", PLANS, ids=[n for _, n in PLANS])
def test_same_as_sql(spark, data, duck, module, name):
    df = module.QUERIES[name](spark, data)
    cur = duck.execute(module.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in cur.fetchall())
