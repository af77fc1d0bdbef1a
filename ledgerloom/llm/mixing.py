"""Mixing sources to target weights (operator 1), built-in functions only.

Every row gets a hash-random key. Inside each source the rows are dealt into key ranges, the
token counts of the ranges are summed up into prefix sums, and the range in which the source's
budget runs out is sorted and summed row by row: rows before that cut are taken once more than
rows after it, and the row at the cut is taken in part. A budget above the source's size takes whole
epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import pin, table, unit_interval, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source gives more than so many times its size.
MAX_EPOCHS = 3
RANGE_ROWS = 4096
KEY_BITS = 31


def targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int, budget_share: float = 1.0) -> DataFrame:
    """For rows (nulls, name, size), one for each source: `target`, the words to take.

    Sources in code point order (null last) get the weights in turn and share budget_share of all
    words. A target stops at max_epochs times its source's size; what is over is shared again by
    weight, until none is above. That fixed point is a water level: with the sources by the level at
    which they fill up, full ones give all they can and the rest share what is left by weight.
    """
    order = Window.orderBy("nulls", "name")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double")).withColumn("most", (F.col("size") * max_epochs).cast("double"))
    fills = Window.orderBy(F.col("most") / F.col("weight"), "nulls", "name")
    everything = Window.partitionBy()
    left = (
        weighed.withColumn("budget", F.sum(F.col("size")).over(everything) * F.lit(float(budget_share)))
        .withColumn("full_before", F.sum("most").over(fills) - F.col("most"))
        .withColumn("weight_left", F.sum("weight").over(everything) - (F.sum("weight").over(fills) - F.col("weight")))
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("most") > F.col("level") * F.col("weight"))
        .withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "nulls", "name", "level"))).over(everything)["level"])
    )
    return left.withColumn("target", F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most")))).select("nulls", "name", "size", "target")


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For rows (source, size, key, tie): a row for each source with target, epochs, cut_key, cut_tie and cut_words.

    A row is taken `epochs` times, once more if (key, tie) is below the cut, and cut_words more at the cut.
    Rows that agree in key and tie share the words at the cut evenly.
    """
    named = sized.select(F.col("source").isNull().alias("nulls"), F.coalesce("source", F.lit("")).alias("name"), "size", "key", "tie")
    ranges = max(1, -(-sized.count() // RANGE_ROWS))
    ranged = named.withColumn("range", F.expr(f"key * {ranges} div {1 << KEY_BITS}"))
    sums = pin(ranged.groupBy("nulls", "name", "range").agg(F.sum("size").alias("size")), "range-sums")
    sources = targets(sums.groupBy("nulls", "name").agg(F.sum("size").alias("size")), weights, max_epochs)
    budgets = pin(
        sources.withColumnRenamed("size", "source_size")
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")),
        "budgets",
    )
    by_range = Window.partitionBy("nulls", "name").orderBy("range")
    prefix = sums.withColumn("before", F.sum("size").over(by_range) - F.col("size"))
    # The range of each source in which the rest of its budget runs out.
    cut_range = prefix.join(budgets, ["nulls", "name"]).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select("nulls", "name", "range", "before", "rest")
    rows = ranged.join(cut_range, ["nulls", "name", "range"]).groupBy("nulls", "name", "before", "rest", "key", "tie").agg(F.sum("size").alias("size"), F.count("*").alias("alike"))
    inside = Window.partitionBy("nulls", "name").orderBy("key", "tie")
    cut = (
        rows.withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
        .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size")))
        .select("nulls", "name", F.col("key").alias("cut_key"), F.col("tie").alias("cut_tie"), F.expr("(rest - start) div alike").alias("cut_words"))
    )
    return budgets.join(cut, ["nulls", "name"], "left").select("nulls", "name", "source_size", "target", "epochs", "cut_key", "cut_tie", "cut_words")


def mix_keys(seed: int) -> tuple[Column, Column]:
    """The hash-random key of a row of documents, and a second hash that orders rows of one key."""
    return unit_interval(F.lit(seed), F.col("doc_id"), F.col("text")), F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text"))


def taken_words(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (source, size, key, tie, ...) with source_size, target, epochs and taken."""
    past = F.coalesce((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") < F.col("cut_tie"))), F.lit(False))
    at = F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("tie") == F.col("cut_tie")), F.lit(False))
    keyed = rows.withColumns({"nulls": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    taken = F.col("epochs") * F.col("size") + F.when(past, F.col("size")).when(at, F.col("cut_words")).otherwise(0)
    return keyed.join(cuts, ["nulls", "name"]).withColumn("taken", taken.cast("long"))


def _mixed_rows(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """(row, size, source_size, target, taken), where row holds all columns of docs."""
    key, tie = mix_keys(seed)
    own = {"source": F.col("source"), "size": word_count(F.col("text")), "key": key, "tie": tie}
    sized = pin(docs.select(*[c.alias(n) for n, c in own.items()]), "sizes")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in own.items()])
    return taken_words(rows, pin(source_cuts(sized, weights, max_epochs), "cuts"))


FIGURES = ("size", "source_size", "target", "taken")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and taken: the words that the mix takes of each row.

    taken is a whole multiple of size but for one row a source, where the budget runs out.
    Null text: size 0, taken 0. Null source: a source of its own, last in order. Equal rows are
    taken alike. An empty table: no rows. The same rows give the same mix in any order. Columns
    of docs with these four names give way to the figures.
    """
    out = _mixed_rows(docs, weights, max_epochs, seed)
    return out.select(*[F.col(f"row.{c}") for c in docs.columns if c not in FIGURES], *FIGURES)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken, cut after its last word where it is taken in part."""
    mixed = _mixed_rows(docs, weights, max_epochs, seed)
    part = F.col("taken") % F.col("size")
    # The text is split after each word, so that the pieces put together again are the text itself.
    pieces = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    begin = F.array_join(F.slice(pieces, 1, part.cast("int")), "")
    times = F.expr("cast(taken div size as int)")
    copies = F.concat(F.array_repeat(F.lit(False), times), F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    shown = mixed.where((F.col("size") > 0) & (F.col("taken") > 0)).withColumn("cut_here", F.explode(copies)).withColumn("begin", F.when(F.col("cut_here"), begin))
    renewed = {"text": F.coalesce("begin", "row.text")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.char_length(renewed["text"]).cast(dict(docs.dtypes)["n_chars"])
    return shown.select(*[renewed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of their sources by weights 1, 2, 3 takes of each."""
    key, tie = mix_keys(17)
    docs = table(spark, sf_dir, "documents")
    sized = pin(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), tie.alias("tie")), "sizes")
    return taken_words(sized, pin(source_cuts(sized), "cuts")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mix_sources": op1_mix_sources}
