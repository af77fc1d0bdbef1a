"""Decisions on fields: what rules, discrepancies, missing proof and security say about each, and whether the document goes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULTS

#: What a discrepancy rule puts before the name of its field.
DISCREPANCY = "ecart_"


def failures_by_field(rules: DataFrame, key: str) -> DataFrame:
    """(key, field, failures): failed rules under every field that they can be about, by rule name.

    A rule is about a field if its name is the field's or starts with it and `_`. So a rule stands under each of its name's prefixes that
    end before a `_`, and meets its fields by equality.
    """
    parts = F.split("rule", "_")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    each = rules.where(~F.col("passed")).select(key, F.explode(F.array_distinct(names)).alias("field"), "rule")
    return each.groupBy(key, "field").agg(F.sort_array(F.collect_set("rule")).alias("failures"))  # as many as there are rules


def review_decisions(decisions: DataFrame, rules: DataFrame, discrepancies: DataFrame, key: str, threshold: float = DEFAULTS.confidence) -> DataFrame:
    """(key, field, value, rejected_value, status, reasons, priority) of each decision.

    decisions: (key, field, value, confidence, verified, suspicious), one row a field. rules: (key, rule, passed); discrepancies: (key, rule, passed) whose
    rule is `ecart_` and a field. A value that no citation verifies moves to rejected_value, and rules and security say nothing more about
    it. priority: the document has a suspicious text, a failed rule or a flagged field. NULL in passed: not evaluated.
    """
    failed = failures_by_field(rules, key)
    far = discrepancies.where(~F.col("passed") & F.col("rule").startswith(DISCREPANCY)).select(key, F.expr(f"substring(rule, {len(DISCREPANCY) + 1})").alias("field"), F.lit(True).alias("far")).distinct()
    broken = rules.where(~F.col("passed")).select(key, F.lit(True).alias("broken")).distinct()
    met = decisions.join(far, [key, "field"], "left").join(failed, [key, "field"], "left").join(broken, key, "left")
    given, proven = F.col("value").isNotNull(), F.coalesce("verified", F.lit(False))
    on = lambda c, reason: F.when(c, reason)
    stands = given & proven
    first = F.array(
        on(~given, "absent"), on(given & F.col("confidence").isNull(), "no confidence"), on(given & (F.col("confidence") < threshold), "low confidence"), on(given & F.coalesce("far", F.lit(False)), "discrepancy"), on(given & ~proven, "no proof")
    )
    by_rule = F.when(stands & F.col("failures").isNotNull(), F.transform("failures", lambda r: F.concat(F.lit("rule "), r))).otherwise(F.array().cast("array<string>"))
    suspicious = F.coalesce("suspicious", F.lit(False))
    reasons = F.array_compact(F.concat(first, by_rule, F.array(on(stands & suspicious, "security"))))
    status = F.when(~given, "absent").when(F.size("reasons") > 0, "signale").otherwise("pre_rempli")
    judged = met.withColumn("reasons", reasons).withColumn("status", status)
    alarms = judged.groupBy(key).agg(F.bool_or((F.col("status") == "signale") | suspicious | F.coalesce("broken", F.lit(False))).alias("priority"))
    shown = judged.select(key, "field", F.when(stands, F.col("value")).alias("value"), F.when(given & ~proven, F.col("value")).alias("rejected_value"), "status", F.array_join("reasons", "|").alias("reasons"))
    return shown.join(alarms, key)
