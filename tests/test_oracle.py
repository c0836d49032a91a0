"""Every registered query with SQL gives the oracle's rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check import TABLES, rows  # noqa: E402

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    relation = duck.execute(ORACLES[name])
    want = rows([d[0] for d in relation.description], relation.fetchall())
    assert got[1] == want[1]
    assert got[0] == want[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["id", "chunk_id", "relevance", "text", "source_label", "relevance_pct"]
