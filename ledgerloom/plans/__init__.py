"""The queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["finance", "records", "texts", "evidence", "answers", "payslips", "statements", "fields", "people", "dossiers"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"ledgerloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"ledgerloom.plans.{m}").ORACLE.items()}
