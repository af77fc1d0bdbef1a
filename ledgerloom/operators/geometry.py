"""Column geometry of recognised tables: where the credit column lies, and which rows lack the amount that belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of a bucket of rows; what lies within its reach is found through the buckets that the reach covers.
BAND = 18.0
#: A row is near another within this distance, or within this many heights of either.
NEAR, HEIGHTS = 18.0, 2.2
#: Headings lie on one row within this many heights; the column reaches past its heading by a share of the gap or some heights, and has a least width.
SAME_ROW, PAST_GAP, PAST_HEIGHTS, LEAST_WIDTH = 1.8, 0.80, 3.0, 20
#: Rows where money comes in, and amounts that stand alone in a cell.
INCOMING = r"(?i)\b(?:(?:virement|virt)\s+(?:recu|en\s+votre\s+faveur)|reception\s+d\s+un\s+virement|versement|remise\s+(?:de\s+)?cheque)\b"
AMOUNT = r"(?i)^[+-]?\s*\d[\d .\x{A0}:]*[,.]\s*\d{2}\s*(?:MAD|DH|DHS)?$"


def _words(text: Column, others: str) -> Column:
    from ledgerloom.functions.text import ACCENTED, PLAIN

    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), others, " ")


def credit_column(tokens: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """(key, left, right, top) of the credit column of each page, from its headings; pages without a pair of headings have no row.

    tokens: (key, order, text, x0, y0, x1, y1, width of the page). The first debit heading, and of its credit headings to the right on
    the same row the first whose column is wide enough, count. Headings alone meet, page by page.
    """
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    heads = tokens.withColumn("_w", F.lower(_words(F.col("text"), "[^a-zA-Z]+"))).where(F.col("_w").rlike(r"\b(?:debit|credit)\b"))
    found = heads.groupBy(key).agg(F.collect_list(F.struct("_w", F.col(order).alias("at"), F.col(width).alias("width"), middle("x0", "x1").alias("x"), middle("y0", "y1").alias("y"), (F.col("y1") - F.col("y0")).alias("h"), F.col("y1").alias("b"))).alias("_heads"))  # a page's headings
    side = lambda word: F.explode(F.filter("_heads", lambda x: x["_w"].rlike(rf"\b{word}\b")))
    pairs = found.withColumn("d", side("debit")).withColumn("c", side("credit"))
    both = pairs.select(key, "d.width", F.col("d.at").alias("d_at"), F.col("c.at").alias("c_at"), *[F.col(f"{s}.{n}").alias(f"{s}{n}") for s in "dc" for n in "xyhb"]).withColumn("h", F.greatest("dh", "ch", F.lit(1.0)))
    both = both.where((F.col("dx") < F.col("cx")) & (F.abs(F.col("dy") - F.col("cy")) <= F.col("h") * SAME_ROW))
    left = F.greatest(F.lit(0), F.floor((F.col("dx") + F.col("cx")) / 2))
    right = F.least(F.floor("width"), F.floor(F.col("cx") + F.greatest((F.col("cx") - F.col("dx")) * PAST_GAP, F.col("h") * PAST_HEIGHTS)))
    shaped = both.select(key, "d_at", "c_at", left.cast("long").alias("left"), right.cast("long").alias("right"), F.greatest(F.lit(0), F.floor(F.greatest("db", "cb"))).cast("long").alias("top"))
    wide = shaped.where(F.col("right") - F.col("left") >= LEAST_WIDTH)
    first = wide.groupBy(key).agg(F.min(F.struct("d_at", "c_at", "left", "right", "top")).alias("f"))
    return first.select(key, "f.left", "f.right", "f.top")


def near_rows(rows: DataFrame, others: DataFrame, key: str, row: str) -> DataFrame:
    """(key, row) of rows (key, row, y, height) that have one of others (key, y, height) within NEAR or HEIGHTS times either's height.

    Either side's own reach decides, so each side looks through the buckets that its reach covers for the other's middle; the
    distance itself is tested then, so that buckets' edges do not show.
    """
    reach = lambda h: F.greatest(F.lit(NEAR), F.col(h) * HEIGHTS)
    band = lambda c: F.floor(c / BAND)
    covered = lambda df, y, h: df.withColumn("_band", F.explode(F.sequence(band(F.col(y) - reach(h)), band(F.col(y) + reach(h)))))
    own = rows.select(key, row, F.col("y").alias("_y"), F.col("height").alias("_h"))
    other = others.select(key, F.col("y").alias("_z"), F.col("height").alias("_g"))
    far = F.abs(F.col("_y") - F.col("_z"))
    by_own = covered(own, "_y", "_h").join(other.withColumn("_band", band(F.col("_z"))), [key, "_band"]).where(far <= reach("_h"))
    by_other = own.withColumn("_band", band(F.col("_y"))).join(covered(other, "_z", "_g"), [key, "_band"]).where(far <= reach("_g"))
    return by_own.select(key, row).union(by_other.select(key, row)).distinct()


def rows_without_amount(tokens: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """(key, row) of incoming operations below the headings that have no amount near them in the credit column: their pages are to be read again.

    row: the token's place in `order`. Pages without a credit column have no row.
    """
    y, x, height = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2, F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    token = F.struct(F.col(order).alias("row"), y.alias("y"), x.alias("x"), height.alias("h"))
    kinds = F.struct(F.when(_words(F.col("text"), "[^a-zA-Z0-9]+").rlike(INCOMING), token).alias("i"), F.when(F.trim("text").rlike(AMOUNT), token).alias("a"))
    told = tokens.select(key, kinds.alias("k")).where("k.i is not null or k.a is not null")
    pages = told.groupBy(key).agg(F.collect_list("k.i").alias("_incoming"), F.collect_list("k.a").alias("_amounts")).where(F.size("_incoming") > 0)  # a page's tokens
    met = pages.join(credit_column(tokens, key, order, width), key)
    amounts = F.filter("_amounts", lambda t: (t["y"] > F.col("top")) & t["x"].between(F.col("left"), F.col("right")))
    reach = lambda t: F.greatest(F.lit(NEAR), t["h"] * HEIGHTS)
    each = met.withColumn("_amounts", amounts).select(key, "top", "_amounts", F.explode("_incoming").alias("t")).where("t.y > top")
    near = F.exists("_amounts", lambda a: F.abs(F.col("t.y") - a["y"]) <= F.greatest(reach(F.col("t")), reach(a)))
    return each.where(~F.coalesce(near, F.lit(False))).select(key, "t.row")
