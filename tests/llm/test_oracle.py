"""Operators with SQL give the rows that DuckDB gives, over whole tables."""

import duckdb
import pytest

from quillpath.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_thirteen_queries():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_decontamination", "op6_ngram_join", "op8_chat_formatting", "op11_merkle_manifest", "op12_minhash_near_dedup", "op13_divergence_audit"])
def test_oracle(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    columns = rel.columns
    assert sorted(columns) == sorted(got.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = sorted(str([text(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(str([text(v) for v in r]) for r in rel.fetchall()) and rows
