"""Date parsers on columns. `today` is always given, so results do not depend on the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits; an impossible day is NULL."""
    shape = {"dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$"}
    return F.coalesce(*[F.when(c.rlike(shape[f]), F.try_to_date(c, f)) for f in formats])


def two_digit_year(c: Column, pivot: int) -> Column:
    """A year of two digits: 1900s from the pivot on, else 2000s."""
    return c + F.when(c >= pivot, 1900).otherwise(2000)


def year_for(day: Column, month: Column, anchors: Column) -> Column:
    """The date with this day and month that lies closest to any of the anchor dates; ties go to the earlier one."""
    years = F.flatten(F.transform(F.array_distinct(F.transform(anchors, F.year)), lambda y: F.array(y - 1, y, y + 1)))
    text = lambda y: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    tries = F.filter(F.transform(F.array_distinct(years), lambda y: text(y).try_cast("date")), lambda d: d.isNotNull())
    near = F.transform(tries, lambda d: F.struct(F.array_min(F.transform(anchors, lambda a: F.abs(F.datediff(d, a)))).alias("distance"), d.alias("date")))
    return F.array_min(near)["date"]


def force_month(day: Column, month: Column) -> Column:
    """The same day in another month (yyyy-MM); NULL where that month has no such day."""
    return F.try_to_date(F.concat_ws("-", month, F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def coalesce_all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), cs)


def _built(day: Column, month: Column, year: Column) -> Column:
    """The date of three numbers; NULL where there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _parts(c: Column, pattern: str) -> list[Column]:
    return [F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("int") for i in (1, 2, 3)]


def loose_date(c: Column, default_year: Column) -> Column:
    """A date with slashes, hyphens, points or blanks and two or four digits of the year, as yyyy-MM-dd, or a day and month of the default year. Two digits are of 1969 to 2068."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    iso, full, short = _parts(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})$"), _parts(text, r"^(\d{1,2})(?:(?=[/. -]\d{1,2}[/. -])[/. -])(\d{1,2})[/. -](\d{4}|\d{2})$"), _parts(text, r"^(\d{1,2})(?:\s*[./-]\s*|\s+)(\d{1,2})$")
    # One kind of mark in a date.
    even = text.rlike(r"^\d{1,2}([/.-])\d{1,2}\1\d{2,4}$") | text.rlike(r"^\d{1,2} \d{1,2} \d{2,4}$")
    year = F.when(full[2] >= 100, full[2]).when(full[2] < 69, full[2] + 2000).otherwise(full[2] + 1900)
    return F.coalesce(_built(iso[2], iso[1], iso[0]), F.when(even, _built(full[0], full[1], year)), F.when(default_year.isNotNull(), _built(short[0], short[1], default_year)))


FULL_NUMERIC = r"(?<!\d)(\d{1,2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*((?:19|20)?\d{2})(?!\d)"
SHORT_NUMERIC = r"(?<!\d)(\d{1,2})\s*[./-]\s*(\d{1,2})(?!\s*[./-]\s*\d)"


def statement_date(c: Column, default_year: Column, anchor_month: Column) -> Column:
    """The first date in a text; a day and month alone lie in the default year, but in the next one in January after an opening balance of December, and in the one before in December after one of January. Two digits are of 1970 to 2069."""
    full, short = _parts(c, FULL_NUMERIC), _parts(c, SHORT_NUMERIC)
    year = F.when(full[2] >= 100, full[2]).when(full[2] < 70, full[2] + 2000).otherwise(full[2] + 1900)
    turned = default_year + F.when((anchor_month == 12) & (short[1] == 1), 1).when((anchor_month == 1) & (short[1] == 12), -1).otherwise(0)
    return F.when(full[0].isNotNull(), _built(full[0], full[1], year)).otherwise(_built(short[0], short[1], turned))


def statement_anchor(c: Column) -> tuple[Column, Column]:
    """(year, month) of the opening balance or of the end of the stated period; without one the year that most full dates of the text have (of equals the first), and no month."""
    preferred = r"(?is)(?:solde\s+(?:de\s+)?d[ée]part|ancien\s+solde|relev[ée].{0,30}?au).{0,50}?(\d{1,2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*((?:19|20)\d{2})"
    named = _parts(c, preferred)
    years = F.transform(F.regexp_extract_all(c, F.lit(FULL_NUMERIC), F.lit(3)), lambda y: y.cast("int"))
    counted = F.transform(F.array_distinct(years), lambda y, i: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), (-i).alias("first"), y.alias("year")))
    return F.coalesce(named[2], F.array_max(counted)["year"]), named[1]


def display_date(c: Column) -> Column:
    """dd/MM/yyyy of a text that is a date with marks or blanks; two digits are of the 2000s."""
    parts = _parts(c, r"^\s*(\d{1,2})(?:\s*[./-]\s*|\s+)(\d{1,2})(?:\s*[./-]\s*|\s+)(\d{2,4})\s*$")
    return F.date_format(_built(parts[0], parts[1], F.when(parts[2] < 100, parts[2] + 2000).otherwise(parts[2])), "dd/MM/yyyy")
