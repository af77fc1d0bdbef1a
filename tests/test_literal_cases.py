"""Each literal case against its known result."""

from __future__ import annotations

import duckdb
import pytest
from literal_cases import ORACLE, QUERIES

from test_oracle import shown


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_case(spark, name):
    df, want = QUERIES[name](spark, ""), duckdb.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    mine = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert mine == sorted(tuple(shown(r[want.columns.index(c)]) for c in sorted(df.columns)) for r in want.fetchall())
