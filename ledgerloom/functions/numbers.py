"""Amount parsers on columns. They differ on purpose: each source writes numbers its own way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def _double(text: Column) -> Column:
    """A double from digits and one point only; Spark's own cast takes suffixes such as 12d too."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def strict_amount(c: Column) -> Column:
    """Document amounts: of point and comma the last one is the decimal sign; one alone is it with 1 or 2 digits after it."""
    text = F.regexp_replace(c, "[  ]", " ")
    text = F.regexp_replace(text, r"(?i)\b(MAD|DHS?|DIRHAMS?)\b", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[^0-9,.\-+ ]", ""), " ", "")
    comma, dot = F.length(text) - F.instr(F.reverse(text), ","), F.length(text) - F.instr(F.reverse(text), ".")
    has_comma, has_dot = text.contains(","), text.contains(".")
    comma_last = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    after = lambda at: F.length(text) - at - 1
    short = lambda at: after(at).isin(1, 2)
    cleaned = (
        F.when(has_comma & has_dot, F.when(comma > dot, comma_last).otherwise(F.regexp_replace(text, ",", "")))
        .when(has_comma, F.regexp_replace(text, ",", F.when(short(comma), F.lit(".")).otherwise(F.lit(""))))
        .when(has_dot & ~short(dot), F.regexp_replace(text, r"\.", ""))
        .otherwise(text)
    )
    return _double(cleaned)


def loose_amount(c: Column) -> Column:
    """Statement amounts: commas are points, everything but digits, points and signs goes; two points are no number."""
    return _double(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s", ""), ",", "."), r"[^0-9.+\-]", ""))


def human_amount(c: Column) -> Column:
    """Amounts typed by people: blanks go, commas are points; anything else, negative or not finite is NULL."""
    value = _double(F.regexp_replace(F.regexp_replace(c, "[\\s  ]", ""), ",", "."))
    return F.when(value >= 0, value)


def chat_number(digits: Column, thousands: Column) -> Column:
    """A number from a message, times 1000 after a k; NULL where it is none."""
    return human_amount(digits) * F.when(F.lower(thousands) == "k", 1000.0).otherwise(1.0)
