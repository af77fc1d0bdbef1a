"""The queries of this subpackage and the SQL that checks them, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

#: Modules with a dictionary QUERIES, and ORACLE where SQL can express the query.
MODULES = ["mixing", "urls", "quality", "chat", "rules", "packing", "sharding", "lines", "jaccard", "fingerprints", "infill", "alignment", "extraction"]


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {name: f for m in MODULES for name, f in import_module(f"ledgerloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {name: sql for m in MODULES for name, sql in getattr(import_module(f"ledgerloom.llm.{m}"), "ORACLE", {}).items()}
