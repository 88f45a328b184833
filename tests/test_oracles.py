"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from scriptoria.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, data):
    at = [names.index(c) for c in sorted(names)]
    show = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(show(r[i]) for i in at) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got, want = df.collect(), con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
