"""Sharding by Hilbert-curve order (operator 9), built-in functions only.

Several metadata dimensions are quantised to 2^bits cells each, every row gets the index of its
cell on the Hilbert curve, the rows are sorted by that index, and the order is cut into runs.
Rows that are close in every dimension land in the same run, so the minimum and maximum of each
dimension in a file's footer prune files for filters on any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import pin, table


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each (state, digit) of the curve: the digit's place along the curve and the next state.

    A state is the entry corner and the direction of a subcube. The place is the inverse Gray code
    of the digit seen from that corner; the next state follows from the place.
    """
    corners = 1 << dims
    turn = lambda v, k: ((v << k % dims) | (v >> (dims - k % dims))) & (corners - 1)
    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: (i & -i).bit_length() - 1  # noqa: E731  zeros below the lowest one
    place_of = {gray(i): i for i in range(corners)}
    places, states = [], []
    for state in range(dims * corners):
        entry, along = state % corners, state // corners
        for digit in range(corners):
            w = place_of[turn(digit ^ entry, dims - (along + 1) % dims)]
            places.append(w)
            corner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            axis = 0 if w == 0 else trailing(w + w % 2) % dims
            states.append(((along + axis + 1) % dims) * corners + (entry ^ turn(corner, along + 1)))
    return places, states


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates in [0, 2^bits), as a long."""
    dims = len(coords)
    if dims * bits > 62:
        raise ValueError("the index must fit in a long")
    places, states = curve_tables(dims)
    # One step a bit, from the highest: the digit has that bit of each coordinate.
    digits = F.array(*[reduce(lambda a, b: a + b, [F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1)) * (1 << a) for a, c in enumerate(coords)]) for b in range(bits - 1, -1, -1)])
    place, state = F.array(*map(F.lit, places)), F.array(*map(F.lit, states))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, digit: Column) -> Column:
        entry = acc["state"] * (1 << dims) + digit
        return F.struct(F.get(state, entry).alias("state"), (acc["at"] * (1 << dims) + F.get(place, entry)).alias("at"))

    return F.aggregate(digits, start, step)["at"]


def _string_image(df: DataFrame, name: str) -> Column:
    """A number that keeps the code point order of a string column: the 6 bytes after the prefix that all values share."""
    low, high = df.agg(F.min(name), F.max(name)).first()
    a, b = (x.encode() if x is not None else b"" for x in (low, high))
    shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return F.conv(F.hex(F.rpad(F.substring(F.encode(F.col(name), "UTF-8"), shared + 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A coordinate in [0, 2^bits) for each column: how many of the column's 2^bits-quantiles lie below the value; null: 0.

    The quantiles are taken over all rows; only 2^bits - 1 numbers a column come to the driver.
    """
    types, out = dict(df.dtypes), []
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    images = [_string_image(df, c) if types[c] == "string" else F.col(c).cast("double") for c in dims]
    cuts = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"c{i}") for i, x in enumerate(images)]).first()
    for i, x in enumerate(images):
        own = sorted(set(cuts[i] or ()))
        below = F.size(F.filter(F.array(*map(F.lit, own)), lambda cut, x=x: cut < x)) if own else F.lit(0)
        out.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(below).cast("int"))
    return out


def shard_by_curve(df: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = 6) -> DataFrame:
    """df with `curve` (index on the curve), `rank` (place in the whole order), `shard` and `slot`.

    Shards are runs of the order whose row counts differ by one at most; slots count from 0
    without gaps. Rows at one place of the curve are ordered by `ties`; rows that agree in those too
    are alike but for their slot. Null in a dimension: the lowest cell. An empty table: no rows.
    df is read three times, so pass columns that are cheap to make (a pinned table).
    """
    on_curve = df.withColumn("curve", hilbert_index(quantised(df, dims, bits), bits))
    # The order is fixed on disk with a row number inside each range, so that every later pass sees the same ranks.
    ordered = pin(on_curve.repartitionByRange("curve", *ties).sortWithinPartitions("curve", *ties).withColumn("__row", F.monotonically_increasing_id()), "curve")
    part, inside = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each range
    starts = counts.withColumn("start", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).select("__part", F.col("start").alias("__start"))
    total = ordered.count()
    rank = F.col("__start") + inside
    return (
        ordered.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")  # as many rows as ranges
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.col("rank") - F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}"))
        .drop("__part", "__row", "__start")
    )


SHARDS, DIMS = 40, ["source", "lang", "size"]


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts (law `rows`), in Hilbert order of source, language and size."""
    docs = table(spark, sf_dir, "documents")
    base = pin(
        docs.select(
            "doc_id", "source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
        ),
        "metadata",
    )
    out = shard_by_curve(base, DIMS, ["text_crc32", "doc_id"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES = {"op9_hilbert_shards": op9_hilbert_shards}
