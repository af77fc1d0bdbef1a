"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal, source mixing and packing.

Each stage works on all rows that the one before kept. The stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import pin, table, unpin
from ledgerloom.llm.jaccard import distinct_documents
from ledgerloom.llm.lines import deduplicated_documents
from ledgerloom.llm.mixing import mixed_documents
from ledgerloom.llm.packing import packed_documents
from ledgerloom.llm.rules import fit_field, kept_documents

#: Near duplicates are documents whose sets of five-word shingles overlap by this many hundredths of their union.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counting rules and the line labels keep; the labels table says what the field is fitted on.

    Rows are judged by their text alone: equal rows stay or go together, null and empty texts go. All columns are kept.
    """
    return kept_documents(docs, fit_field(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; documents of which nothing is left go.

    Rows without doc_id keep their lines, equal rows have theirs cut alike, and different texts under one doc_id are cut apart.
    """
    return deduplicated_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, null last.

    Different texts under one doc_id are different documents; of rows equal in doc_id and text one stays. Rows without words all stay.
    """
    return distinct_documents(docs, NEAR_WORDS, NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them: whole copies, and one cut one for each source.

    Rows without words go; a null source is a source; rows that share a doc_id are taken each for itself.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in packed sequences; null and empty texts have the end id alone. Equal rows are packed each for itself."""
    return packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("source mix", source_mix), ("packing", packing)]

#: SQL can express neither the field's labels nor the tokenizer. No test holds whole stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again; a stage's rows go when the next has been written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, pin(stage(spark, docs, sf_dir), f"stage-{k}")
        unpin(before)
    return docs
