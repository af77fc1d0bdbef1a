"""Loan arithmetic on columns; an invalid request gives NULL and a code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    return ok


def payment_error(price: Column, contribution: Column, years: Column, rate: Column) -> Column:
    return (
        F.when(~finite(price, contribution, years, rate), "not_finite")
        .when(price <= 0, "price")
        .when((contribution < 0) | (contribution > price), "contribution")
        .when(years <= 0, "years")
        .when(rate < 0, "rate")
    )


def annuity(capital: Column, rate: Column, months: Column) -> Column:
    """The constant monthly payment; without interest the capital is spread evenly."""
    r = rate / 1200.0
    return F.when(capital == 0, 0.0).when(rate == 0, capital / months).otherwise(capital * r / (1 - F.pow(1 + r, -months)))


def present_value(payment: Column, rate: Column, months: Column) -> Column:
    """What a constant monthly payment can borrow."""
    r = rate / 1200.0
    return F.when(rate == 0, payment * months).otherwise(payment * (1 - F.pow(1 + r, -months)) / r)


def debt_ratio(income: Column, charges: Column) -> Column:
    """Charges over income; NULL without income or with negative charges."""
    return F.when((income > 0) & (charges >= 0), charges / income)


def default_durations(years: Column) -> Column:
    """Three durations around the chosen one, within 5 to 30 years, ascending."""
    c = years.cast("int")
    low, high = F.lit(5), F.lit(30)
    around = (
        F.when(c <= 7, F.array(c, F.least(high, c + 5), F.least(high, c + 10)))
        .when(c >= 28, F.array(F.greatest(low, c - 10), F.greatest(low, c - 5), c))
        .otherwise(F.array(F.greatest(low, c - 5), c, F.least(high, c + 5)))
    )
    own = F.sort_array(F.array_distinct(around))
    filler = F.array_except(F.sequence(low, high), own)
    return F.sort_array(F.slice(F.concat(own, filler), 1, 3))
