"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v) -> str:
    return "\0" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(shown(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert mine == theirs


def test_every_query_has_rows_or_sql(spark):
    for name in set(plans.queries()) - set(ORACLE):
        assert plans.queries()[name](spark, SF).count() > 0, name
