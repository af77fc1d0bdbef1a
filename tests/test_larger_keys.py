"""Queries against their SQL on orders whose keys only larger tables have."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom import plans
from tests.test_oracle import SF, shown

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


def equals_sql(spark, folder, name, where):
    """Whether a query gives what its SQL gives on orders, written by a SELECT over those of the smallest tables."""
    con = duckdb.connect()
    con.sql(f"copy (select o.* replace ({where}) from (select *, row_number() over (order by o_orderkey) - 1 i from '{SF}/orders.parquet') o) to '{folder}/orders.parquet'")
    con.sql(f"create view orders as select * exclude (i) from '{folder}/orders.parquet'")
    df, want = QUERIES[name](spark, str(folder)), con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


#: Their names are like "mutuelle" (162552, 625524), "virement" and "reception" (92248), and both "versement" and "virement" (2926270 to 2926279).
KEYS = "[162552, 625524, 625525, 62552, 92248, 42627, 2926270, 2926271, 2926272, 2926273, 2926274, 2926275]"


@pytest.mark.parametrize("name", ["income_exclusion", "incoming_flag", "income_evidence", "extra_income"])
def test_names_like_keywords(spark, tmp_path, name):
    equals_sql(spark, tmp_path, name, f"case when i < 12 then ({KEYS})[i + 1] else o_orderkey end as o_orderkey")


def test_payslip_labels_are_read_once(spark):
    """Texts are dealt by document before patterns run on them, and the lines with labels are read in one place of the plan."""
    plan = QUERIES["payslip_extraction"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(") == 3
    assert "RepartitionByExpression [o_orderkey" in plan


def test_rows_of_texts_without_sorting(spark):
    from ledgerloom.operators.texts import text_rows

    texts = [(1, "a\r\n\n [page 2] \n b\n[PAGE x]\nc\n[PAGE 7]"), (2, "[PAGE 3]\nd\n[PAGE 99999999999]\ne"), (3, ""), (4, None), (5, "f")]
    rows = text_rows(spark.createDataFrame(texts, "k long, t string"), "k", "t", "n")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 1, "a", 4), (1, 1, 2, "b", 4), (1, 2, 2, "[PAGE x]", 4), (1, 3, 2, "c", 4), (2, 0, 3, "d", 3), (2, 1, 3, "[PAGE 99999999999]", 3), (2, 2, 3, "e", 3), (5, 0, 1, "f", 1)]
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
