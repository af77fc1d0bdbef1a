"""Loan offers, discrepancies and monthly figures as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULTS
from ledgerloom.functions import loans


def cents(c: Column) -> Column:
    """Rounded half up to two digits in plain double arithmetic, which every engine does alike."""
    return F.floor(c * 100 + 0.5) / 100


def loan_payments(df: DataFrame, price: Column, contribution: Column, years: Column, rate: Column) -> DataFrame:
    """df with capital, payment, interest and error; invalid requests have NULL figures and a code."""
    error, months = loans.payment_error(price, contribution, years, rate), years * 12
    capital = price - contribution
    payment = loans.annuity(capital, rate, months)
    ok = error.isNull()
    return df.withColumns({"capital": F.when(ok, F.round(capital, 2)), "payment": F.when(ok, cents(payment)), "interest": F.when(ok, cents(payment * months - capital)), "error": error})


def loan_scenarios(df: DataFrame, price: Column, contribution: Column, durations: Column, rate: Column, income: Column, charges: Column) -> DataFrame:
    """A row for each distinct duration: payment, cost and the debt ratio in percent (NULL without income)."""
    rows = df.withColumns({"_price": price, "_own": contribution, "_rate": rate, "_income": income, "_charges": charges}).withColumn("years", F.explode(F.sort_array(F.array_distinct(durations))))
    capital, months = F.col("_price") - F.col("_own"), F.col("years") * 12
    payment = loans.annuity(capital, F.col("_rate"), months)
    ratio = F.when(F.col("_income") > 0, F.round((payment + F.coalesce(F.col("_charges"), F.lit(0.0))) / F.col("_income") * 100, 2))
    figures = {"capital": F.round(capital, 2), "payment": F.round(payment, 2), "interest": F.round(payment * months - capital, 2) + 0.0, "total": F.round(payment * months, 2), "debt_ratio": ratio}
    return rows.withColumns(figures).drop("_price", "_own", "_rate", "_income", "_charges")


def borrowing_capacity(df: DataFrame, income: Column, charges: Column, contribution: Column, years: Column, rate: Column, target_ratio: Column) -> DataFrame:
    """df with what the income leaves for a payment, what that borrows, and the highest price."""
    error = (
        F.when(~loans.finite(income, charges, contribution, years, rate, target_ratio), "not_finite").when(income <= 0, "income").when(charges < 0, "charges").when(contribution < 0, "contribution")
        .when(years <= 0, "years").when(rate < 0, "rate").when((target_ratio <= 0) | (target_ratio > 100), "ratio")
    )
    months = F.floor(years * 12)
    available = F.greatest(F.lit(0.0), income * target_ratio / 100 - charges)
    loan = loans.present_value(available, rate, months)
    ok = error.isNull()
    figures = {
        "available": available, "loan": loan, "interest": F.greatest(F.lit(0.0), available * months - loan), "max_price": loan + contribution, "current_ratio": charges / income * 100,
    }
    return df.withColumns({n: F.when(ok, F.round(c, 2)) for n, c in figures.items()} | {"error": error})


def discrepancies(df: DataFrame, declared: Column, extracted: Column, threshold: float = DEFAULTS.discrepancy, critical: float = DEFAULTS.critical_discrepancy) -> DataFrame:
    """df with ratio, passed and severity. A declared 0 passes only against 0 and has no ratio; a missing side is not evaluated."""
    ratio = F.when(declared != 0, F.abs(extracted - declared) / F.abs(declared))
    passed = F.when(declared.isNull() | extracted.isNull(), F.lit(None).cast("boolean")).when(declared == 0, extracted == 0).otherwise(ratio <= threshold)
    severity = F.when(ratio.isNull(), F.lit(None).cast("string")).when(ratio <= threshold, "information").when(ratio <= critical, "avertissement").otherwise("critique")
    return df.withColumns({"ratio": F.round(ratio, 6), "passed": passed, "severity": severity})


def monthly_totals(df: DataFrame, key: str, period: Column, amount: Column) -> DataFrame:
    """(key, period, total, n): amounts summed by period, and how many; the sum is rounded so that its order does not show."""
    return df.groupBy(key, period.alias("period")).agg(F.round(F.sum(amount), 2).alias("total"), F.count("*").alias("n"))


def steady_figure(totals: DataFrame, key: str) -> DataFrame:
    """(key, months, n, median, deviation): the median of the periods' totals, what they were summed from, and the largest relative distance from the median."""
    out = totals.groupBy(key).agg(F.median("total").alias("median"), F.count("*").alias("months"), F.sum("n").alias("n"), F.collect_list("total").alias("totals"))  # a key's months
    far = F.array_max(F.transform("totals", lambda t: F.when(F.col("median") != 0, F.abs(t - F.col("median")) / F.abs(F.col("median")))))
    return out.select(key, "months", "n", "median", far.alias("deviation"))


def credit_charge(totals: DataFrame, key: str, gate: float = DEFAULTS.charge_deviation) -> DataFrame:
    """The monthly charge: the median, or NULL where several months differ by more than the gate from it."""
    unsteady = (F.col("months") > 1) & ((F.col("median") == 0) | (F.col("deviation") > gate))
    return steady_figure(totals, key).select(key, "months", F.when(~unsteady, F.round("median", 2)).alias("charge"), F.when(~unsteady, 0.5).alias("confidence"))


def complementary_income(totals: DataFrame, key: str, gate: float = DEFAULTS.income_deviation) -> DataFrame:
    """The monthly income: 0 where months differ by more than the gate, else the median; surer with several months."""
    irregular = (F.col("months") > 1) & ((F.col("median") == 0) | (F.col("deviation") > gate))
    value = F.when(irregular, 0.0).otherwise(F.round("median", 2))
    confidence = F.when(irregular, 0.25).when(F.col("months") >= 2, 0.6).otherwise(0.4)
    return steady_figure(totals, key).select(key, "months", value.alias("income"), confidence.alias("confidence"))


def low_and_high_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, low, high, label): the lower and the upper median, and how regular the values are."""
    out = df.groupBy(key).agg(
        F.count(value).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("low"), F.expr(f"percentile_disc(0.5) within group (order by {value} desc)").alias("high"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    )
    spread = (F.col("most") - F.col("least")) / F.greatest(F.abs("low"), F.lit(1.0))
    label = F.when(F.col("n") == 1, "single").when(F.col("least") == F.col("most"), "equal").when(spread <= 0.2, "regular").otherwise("variable")
    return out.select(key, "n", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), label.alias("label"))
