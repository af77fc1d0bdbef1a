"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the letters they fold to.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_white(c: Column) -> Column:
    """Without white space of any kind at either end; trim takes blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Lower case without accents and with single blanks."""
    # A text of as many bytes as characters has no accents, and translating is dear. White space is single blanks when the ends are cut.
    plain = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def collapse(c: Column) -> Column:
    """Lower case with single blanks; accents stay."""
    return F.lower(strip_white(F.regexp_replace(c, r"\s+", " ")))


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: an apostrophe goes before = + - @ at the start."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def normal_email(c: Column) -> Column:
    return F.lower(strip_white(c))


def valid_email(c: Column) -> Column:
    return F.coalesce(normal_email(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


def usable_native_text(c: Column) -> Column:
    """Whether a page's own text can be used: 40 characters but white space, 20 letters or digits, no broken glyphs."""
    dense = F.regexp_replace(c, r"\s", "")
    marks = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.coalesce((F.length(dense) >= 40) & (marks >= 20) & ~dense.rlike(r"[\p{Cc}\x{FFFD}]") & ~F.lower(c).contains("(cid:"), F.lit(False))


def candidate_id(page: Column, date: Column, amount: Column, description: Column, quote: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a transaction's parts; missing parts count as empty."""
    parts = [page.cast("string"), date, F.format_string("%.2f", amount), fold(description), fold(quote)]
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)
