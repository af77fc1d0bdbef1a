"""Audit events, upserts, dossiers, rules and decisions as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULTS


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], first_write: dict[str, str] | None = None) -> DataFrame:
    """Rows of old and new with the last one of each key; columns in first_write keep the value of the first row by the given column."""
    both = old.unionByName(new)
    out = latest(both, keys, order)
    if first_write:
        firsts = both.groupBy(*keys).agg(*[F.min_by(c, F.struct(by, *order)).alias(c) for c, by in first_write.items()])
        out = out.drop(*first_write).join(firsts, keys)
    return out.select(*old.columns)


def delete_rows(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")


def new_rows(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows of df whose normalised key is not known; of equal new keys the first in natural order stays out of the caller's sight no more than once."""
    return df.withColumn("_key", key).join(known.select(known_key.alias("_key")), "_key", "left_anti").drop("_key")


def audit_trail(events: DataFrame, where: Column, id_column: str, limit: int = 200) -> DataFrame:
    """The last events that match; a top-k report."""
    return events.where(where).orderBy(F.col(id_column).desc()).limit(limit)


def rule_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule, passed): each rule of each row; NULL means that it could not be evaluated."""
    each = F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("boolean").alias("passed")) for n, c in rules.items()])
    return df.select(key, F.explode(each).alias("r")).select(key, "r.*")


def rule_summary(rows: DataFrame, key: str) -> DataFrame:
    """Counts of passed, failed and not evaluated rules; valid means that none failed, score is passed over evaluated."""
    passed, failed, skipped = (F.count_if(c) for c in (F.col("passed"), ~F.col("passed"), F.col("passed").isNull()))
    out = rows.groupBy(key).agg(F.count("*").alias("total"), passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"))
    score = F.when(F.col("passed") + F.col("failed") > 0, F.round(F.col("passed") / (F.col("passed") + F.col("failed")), 2)).otherwise(0.0)
    return out.withColumns({"score": score, "valid": F.col("failed") == 0})


def field_decisions(df: DataFrame, value: Column, confidence: Column, verified: Column, rule_failed: Column, suspicious: Column, threshold: float = DEFAULTS.confidence) -> DataFrame:
    """df with status (absent, pre_rempli, signale) and the reasons in order."""
    no = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~no(verified), "source"), F.when(confidence.isNull(), "no confidence").when(confidence < threshold, "low confidence"), F.when(no(rule_failed), "rule"), F.when(no(suspicious), "security")
        )
    )
    status = F.when(value.isNull(), "absent").when(F.size(reasons) > 0, "signale").otherwise("pre_rempli")
    return df.withColumns({"status": status, "reasons": F.when(value.isNull(), "").otherwise(F.array_join(reasons, "|"))})


def agreed_value(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, n_values, status, value): a conflict where there are several values, else the last one."""
    out = df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.max_by(value, F.struct(*order)).alias("value"))
    return out.select(*keys, "n_values", F.when(F.col("n_values") > 1, "conflict").otherwise("confirmed").alias("status"), F.when(F.col("n_values") == 1, F.col("value")).alias("value"))


def coverage(df: DataFrame, key: str, type_column: str, done: Column, required: list[str]) -> DataFrame:
    """(key, n_done, missing, complete, progress): which required types are done; progress is truncated to whole percents."""
    found = df.groupBy(key).agg(F.collect_set(F.when(done, F.col(type_column))).alias("found"))  # at most as many as there are types
    need = F.array(*[F.lit(r) for r in required])
    have = F.array_intersect("found", need)
    return found.select(
        key, F.size(have).alias("n_done"), F.array_join(F.array_except(need, "found"), "|").alias("missing"), (F.size(have) == len(required)).alias("complete"), F.floor(F.size(have) * 100 / len(required)).cast("int").alias("progress")
    )


def dossier_status(covered: DataFrame, verified: Column, flagged: Column) -> DataFrame:
    """covered with status; a saved verdict wins, then corrections, then readiness."""
    status = F.when(verified, "verified").when(flagged, "to_correct").when(F.col("complete"), "ready").when(F.col("n_done") > 0, "to_check").otherwise("incomplete")
    return covered.withColumn("status", status)


def cascade_delete(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], start: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows that `gone` (columns of `start`) names and all that hangs on them.

    links: (parent, its key, child, its reference), each parent before its children's own links. What goes travels level by level: the keys
    of rows that go select the children that go, and rows without a reference stay.
    """
    going = {start: [tables[start].join(gone.distinct(), gone.columns, "left_semi")]}
    left = dict(tables) | {start: tables[start].join(gone.distinct(), gone.columns, "left_anti")}
    for parent, key, child, reference in links:
        for rows in going.get(parent, []):
            keys = rows.select(F.col(key).alias(reference)).distinct()
            going.setdefault(child, []).append(tables[child].join(keys, reference, "left_semi").select(*tables[child].columns))
            left[child] = left[child].join(keys, reference, "left_anti").select(*tables[child].columns)
    return left


def checked_insert(new: DataFrame, known: DataFrame, key: Column, known_key: Column, order: list[str], checks: dict[str, Column]) -> DataFrame:
    """new with `accepted` and `reason`: the first failing check, `known` for keys that exist already, `repeated` for all but the first by `order` of
    the valid new rows with one key; NULL for what is accepted.

    A check that cannot be evaluated fails. Rows with a NULL key are not compared with others.
    """
    failing = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), reason) for reason, c in checks.items()]) if checks else F.lit(None).cast("string")
    judged = new.withColumns({"_key": key, "_failing": failing})
    there = known.select(known_key.alias("_key")).where("_key is not null").distinct().withColumn("_known", F.lit(True))
    met = judged.join(there, "_key", "left")
    fine = met.where("_failing is null and _known is null and _key is not null").groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    place = met.join(fine, "_key", "left")
    again = F.col("_first").isNotNull() & (F.struct(*order) != F.col("_first"))
    reason = F.coalesce(F.col("_failing"), F.when(F.col("_known"), "known"), F.when(again, "repeated"))
    return place.withColumns({"reason": reason, "accepted": reason.isNull()}).drop("_key", "_failing", "_known", "_first")
