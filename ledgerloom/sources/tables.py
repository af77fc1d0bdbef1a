"""Tables and files as DataFrames, and the CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes (hexadecimal) of each file type that is accepted.
SIGNATURES = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def file_control(df: DataFrame, max_bytes: int) -> DataFrame:
    """df (path, length, head) with valid and reason; the first failing check names the reason. head: the first bytes in hexadecimal."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    signed = F.lit(False)
    for name, magic in SIGNATURES.items():
        signed = signed | ((extension == name) & F.col("head").startswith(magic))
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large").when(~extension.isin(*SIGNATURES), "extension").when(~F.coalesce(signed, F.lit(False)), "signature")
    return df.withColumns({"valid": reason.isNull(), "reason": F.coalesce(reason, F.lit("ok"))})


def write_csv(df: DataFrame, path: str, separator: str = ",", mark: bool = False) -> None:
    """A CSV data set in which no cell is taken for a formula. mark: each file starts with a byte order mark, by which spreadsheets know UTF-8."""
    from ledgerloom.functions.text import csv_cell

    safe = [csv_cell(F.col(n)).alias(("\ufeff" if mark and not i else "") + n) if t == "string" else F.col(n).alias(("\ufeff" if mark and not i else "") + n) for i, (n, t) in enumerate(df.dtypes)]
    df.select(*safe).write.mode("errorifexists").option("header", "true").option("sep", separator).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends to the audit log."""
    df.write.mode("append").parquet(path)
