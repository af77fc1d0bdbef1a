"""The corpus pipeline: columns, and what each stage's decisions leave."""

from __future__ import annotations

import corpus_pipeline
from ledgerloom.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "source mix", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.count()
    assert 0 < seen["near duplicates"] <= seen["line dedup"] <= seen["quality rules"] < 200
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_registry_names():
    names = set(registry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
