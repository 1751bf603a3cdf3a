"""Driver contract: entry() runs; every key has a Spark plan and oracle SQL that agree."""

import duckdb
import pytest

import __spark_entry__ as E
from rankboard.plans.catalog import QUERIES
from rankboard.plans.oracle import SQL

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "events", "part", "nation", "region"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["display_name", "email", "total_points", "questions_answered"]
    assert df.count() > 0


def test_every_query_has_oracle_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(dcols, res.fetchall())
