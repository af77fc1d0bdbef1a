"""Document fingerprints by invertible Bloom lookup sketches (operator 6), built-in functions only.

The paragraphs of a text are hashed to digests, and each digest is added to three cells of a sketch:
a cell holds how many digests it has, their exclusive or, and the exclusive or of their checks. Sketches of two
versions subtract cell by cell, which leaves the differing digests alone. Peeling recovers those: a cell
with one digest names it, and taking it out of its other cells opens more. When cells stay closed,
the pair is done again with sketches four times as large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import pin, table, unpin

#: A paragraph is a line; a longer line is cut at the first sentence end after so many characters.
PARAGRAPH = r"[^\n]{1,200}[^\n.!?]*[.!?]*"
#: Cells of the smallest sketch (a third of them for each hash), which is the fingerprint itself.
CELLS, GROWTH = 12, 4
ROUNDS = 4
BUCKET_ROWS, MAX_BUCKETS = 4096, 65_536
#: Digests whose sketches a task peels, about.
TASK_DIGESTS = 1 << 16
KINDS = ("edited", "next")


def range_bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most value, by binary search."""
    if not cuts:
        return F.lit(0)
    held, steps = F.array(*[F.lit(c).cast("long") for c in cuts]), [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(held, at + s - 1) <= value, F.lit(False)), at + s).otherwise(at))


def with_next_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the next row by doc_id (null first; equal ids by a hash of the text), the first after the last.

    Rows are dealt into ranges of doc_id, each range looks at the row after in itself, and for its last row it also gets
    the first row of the range that follows. Texts are shuffled once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
    found = rows.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], 100_000)).first()[0] if buckets > 1 else []
    dealt = rows.withColumn("bucket", range_bucket(F.col("at"), sorted(set(found or []))))
    firsts = dealt.groupBy("bucket").agg(F.min("at").alias("first"))  # MAX_BUCKETS rows at most
    chain = Window.orderBy("bucket")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(chain), F.max("bucket").over(Window.partitionBy())))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    placed = dealt.join(F.broadcast(firsts), "bucket").withColumn("place", F.explode(F.when(F.col("at") == F.col("first"), F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("place.bucket").orderBy("place.guest", "at", F.xxhash64("text"), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where(~F.col("place.guest")).select("doc_id", "text", "next_text")


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def cell(digest: Column, cells: Column, third: int) -> Column:
    """The cell of a digest in one third of a sketch of so many cells."""
    part = F.floor(cells / 3)
    return (F.pmod(F.xxhash64(digest, cells, F.lit(third)), part) + part * third).cast("int")


def sketches(rows: DataFrame, keys: list[str], digests: str) -> DataFrame:
    """(keys, cell, c, k, h): the sketches of rows with `size` (cells) among the keys and an array of distinct digests; empty cells have no row."""
    each = rows.select(*keys, F.explode(digests).alias("d"))
    spread = each.select(*keys, "d", check(F.col("d")).alias("q"), F.explode(F.array(*[cell(F.col("d"), F.col("size"), t) for t in range(3)])).alias("cell"))
    return spread.groupBy(*keys, "cell").agg(F.count("*").alias("c"), F.bit_xor("d").alias("k"), F.bit_xor("q").alias("h"))


def subtracted(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The cells (keys, cell, c, k, h) of the first sketches less the second ones; cells that are all zero have no row."""
    both = first.unionByName(second.withColumn("c", -F.col("c")))
    return both.groupBy(*keys, "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where("c <> 0 or k <> 0 or h <> 0")


def peeled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell, digest, side, ...) from difference sketches: a row for each digest that comes out, with its side (1: of the first version alone,
    -1: of the second), and one with a null digest for each cell that stays closed.

    The thirds of a sketch take turns: in its turn, every cell of a third that holds one digest gives it up. A digest has
    one cell in each third, so none is given up twice.
    """
    size = F.col("size")
    cells = cells.withColumn("digest", F.lit(None).cast("long"))
    for turn in range(3 * ROUNDS):
        third = turn % 3
        pure = F.col("digest").isNull() & (F.abs("c") == 1) & (F.floor(F.col("cell") / F.floor(size / 3)) == third) & (F.col("h") == check(F.col("k"))) & (F.col("cell") == cell(F.col("k"), size, third))
        entry = lambda at, c, k, h, d: F.struct(at.cast("int").alias("cell"), c.cast("long").alias("c"), k.alias("k"), h.alias("h"), d.cast("long").alias("digest"))
        none, zero = F.lit(None), F.lit(0).cast("long")
        taken = [entry(cell(F.col("k"), size, t), -F.col("c"), F.col("k"), F.col("h"), none) for t in range(3) if t != third]
        out = entry(F.lit(-1), F.col("c"), zero, zero, F.col("k"))
        kept = F.array(entry(F.col("cell"), F.col("c"), F.col("k"), F.col("h"), F.col("digest")))
        after = cells.select(*keys, F.explode(F.when(pure, F.array(*taken, out)).otherwise(kept)).alias("x")).select(*keys, "x.*")
        cells = after.groupBy(*keys, "cell", "digest").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where("c <> 0 or k <> 0 or h <> 0")
    return cells.select(*keys, "digest", F.col("c").alias("side"))


def sketch_size(digest_count: Column) -> Column:
    """The smallest of CELLS, CELLS * GROWTH, ... that is at least one and a half times a count of digests."""
    sizes = [CELLS * GROWTH**i for i in range(12)]
    out = F.lit(sizes[-1])
    for s in reversed(sizes[:-1]):
        out = F.when(digest_count * 3 <= s * 2, s).otherwise(out)
    return out


def differing_digests(pairs: DataFrame, tries: int = 8) -> DataFrame:
    """(uid, kind, digest, side): the digests that versions x and y of pairs (uid, kind, x, y), arrays of distinct digests, do not share.

    side: 1 for digests of x alone, -1 for those of y alone. Equal versions have no row. Each version gets its sketch, the two are subtracted
    and the difference is peeled. A pair starts with sketches that fit half as many digests again as it could have
    different ones at least, by its sizes, and takes GROWTH times as large ones whenever cells stay closed.
    """
    keys, done = ["uid", "kind", "size"], None
    guess = F.greatest(F.abs(F.size("x") - F.size("y")), F.ceil((F.size("x") + F.size("y")) / 2).cast("int"))
    waiting = pin(pairs.select("uid", "kind", sketch_size(guess).alias("size"), "x", "y"), "pairs")
    for _ in range(tries):
        # Dealt by pair once, both sketches, the subtraction and every turn of the peeling stay inside a partition; its digests are so few that its cells fit in memory.
        total = waiting.agg(F.coalesce(F.sum(F.size("x").cast("long") + F.size("y")), F.lit(0))).first()[0]
        dealt = waiting.repartition(max(1, -(-total // TASK_DIGESTS)), "uid", "kind")
        result = pin(peeled(subtracted(sketches(dealt, keys, "x"), sketches(dealt, keys, "y"), keys), keys), "peeled")
        failed = result.where("digest is null").select(*keys).distinct()
        good = result.join(failed, keys, "left_anti").select("uid", "kind", "digest", "side")
        done = good if done is None else done.union(good)
        if failed.isEmpty():
            unpin(waiting)
            return done
        larger = pin(waiting.join(failed, keys, "left_semi").withColumn("size", F.col("size") * GROWTH), "pairs")
        unpin(waiting)
        waiting = larger
    raise RuntimeError("digests that peel at no size")


def differences(pairs: DataFrame, tries: int = 8) -> DataFrame:
    """(uid, kind, differing): how many digests differing_digests recovers of each pair; equal versions have no row."""
    return differing_digests(pairs, tries).groupBy("uid", "kind").agg(F.count("*").alias("differing"))


def fingerprint(name: str) -> Column:
    """The smallest sketch of a version as text: count, digests and checks of each cell in hexadecimal."""
    hexed = lambda c, width: F.lpad(F.right(F.hex(c), F.lit(width)), width, "0")
    found = F.map_from_entries(F.col(name))
    one = lambda i: F.coalesce(F.concat(hexed(found[i]["c"], 4), hexed(found[i]["k"], 16), hexed(found[i]["h"], 8)), F.lit("0" * 28))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), one), "")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs (doc_id, text).

    Likeness is 1 less the differing digests over the digests of both; two texts without paragraphs are alike (1).
    A paragraph that repeats in a text counts once. Null text: empty. Of a table of one row, the next row is the row itself.
    """
    both = with_next_text(docs)
    edited = F.expr("concat(left(text, char_length(text) - cast(char_length(text) div 2 as int)), left(next_text, cast(char_length(text) div 2 as int)))")
    rows = both.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), digests(F.col("next_text")).alias("next")
    )
    rows = pin(rows, "digests")
    prints = None
    by_row = rows.repartition("uid")
    for name in ("own", "edited"):
        version = by_row.select("uid", F.lit(CELLS).alias("size"), name)
        cells = sketches(version, ["uid", "size"], name).groupBy("uid").agg(F.collect_list(F.struct("cell", F.struct("c", "k", "h").alias("v"))).alias(name))  # CELLS entries at most
        prints = cells if prints is None else prints.join(cells, "uid", "full")
    empty = F.array().cast("array<struct<cell:int,v:struct<c:bigint,k:bigint,h:bigint>>>")
    prints = by_row.select("uid").join(prints, "uid", "left").select("uid", *[F.coalesce(F.col(n), empty).alias(n) for n in ("own", "edited")]).select("uid", fingerprint("own").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"))
    pairs = rows.select("uid", F.col("own").alias("x"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("y")) for k in KINDS])).alias("p")).select("uid", "x", "p.kind", "p.y")
    found = differences(pairs.where("x <> y")).groupBy("uid").agg(*[F.sum(F.when(F.col("kind") == k, F.col("differing"))).alias(f"d_{k}") for k in KINDS])
    sizes = rows.select("uid", "doc_id", "n_chars", "edited_sha256", *[F.size(c).alias(f"n_{c}") for c in ("own", *KINDS)])

    def likeness(kind: str) -> Column:
        total = F.col("n_own") + F.col(f"n_{kind}")
        return F.when(total == 0, 1.0).otherwise(1.0 - F.coalesce(F.col(f"d_{kind}"), F.lit(0)) / total).alias(f"near_{kind}")

    out = sizes.join(prints, "uid").join(found, "uid", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited"), likeness("next"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the fingerprints of their texts and edited texts, and the likenesses read from them."""
    return fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprint": op6_fingerprint}
