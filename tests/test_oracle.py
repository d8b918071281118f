"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from quillpath.plans import meta_queries, relational, table_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**relational.queries(), **meta_queries.queries(), **table_queries.queries()}
SQL = {**relational.oracle_sql(), **meta_queries.oracle_sql(), **table_queries.oracle_sql()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return [text(x) for x in v] if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = duck.sql(SQL[name])
    names = rel.columns
    assert sorted(names) == columns
    rows = sorted(str([text(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([text(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
