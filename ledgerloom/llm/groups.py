"""Connected groups, and near-duplicate links from postings without all pairs of a key (operators 3 and 10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import pin, unpin

#: Rows of a key outside its largest group that are compared with the key's others in one block; a key with more is dealt to several.
CROWD = 64


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id that is reachable.

    Alternating star steps: each vertex hands the smallest neighbour to its larger neighbours, then to its smaller ones.
    The number of rounds grows with the logarithm of the longest path; each round is written to the shared folder.
    """
    now = pin(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    shape = None
    while True:
        both = now.union(now.select("b", "a"))
        # Large star: the neighbours above a vertex are linked to its smallest neighbour, itself included.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        # Small star: a vertex and the neighbours below it are linked to the smallest of them.
        down = large.distinct()
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y")
        after = pin(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        # Settled when a round changes no link.
        was, shape = shape, tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        unpin(now)
        now = after
        if shape == was:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def shared_postings(postings: DataFrame, info: list[str], where: str = "true") -> DataFrame:
    """The postings (k, id, *info) of keys that several ids have, with the number of the key's rows and its least id as `hub`, with hub_* for its info.

    Of keys with the very same ids one is kept. where: a condition on n_rows, low_* and high_* (the range of info) that keys must meet.
    """
    # Counted first and written, so that the joins read plain exchanges, in which Spark splits hot keys.
    repeated = pin(postings.groupBy("k").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("k"), "repeated-keys")
    met = pin(postings.join(repeated, "k", "left_semi"), "met")
    unpin(repeated)
    own = F.xxhash64("id")
    hub = [F.min("id").alias("hub"), *[f(c).alias(n + c) for c in info for f, n in ((lambda c: F.min_by(c, "id"), "hub_"), (F.min, "low_"), (F.max, "high_"))]]
    alike = met.groupBy("k").agg(*hub, F.count("*").alias("n_rows"), F.bit_xor(own).alias("x"), F.bit_xor(F.xxhash64(own, F.lit(1))).alias("y")).where(where)
    names = ["hub", *[f"hub_{c}" for c in info]]
    keys = pin(alike.groupBy(*names, "n_rows", "x", "y").agg(F.min("k").alias("k")).select("k", "n_rows", *names), "keys")
    shared = pin(met.join(keys, "k"), "postings")
    unpin(met, keys)
    return shared


def grouped(
    postings: DataFrame, info: list[str], near: Callable, links: Callable[[DataFrame], DataFrame], keys: DataFrame | None = None, closer: tuple[DataFrame, Callable] | None = None
) -> DataFrame:
    """(id, component) of the ids that have links.

    postings: (k, id, *info), distinct, where info depends on the id. near(x, y): a condition that pairs must meet, on two
    mappings from names in info to columns. links: from candidate pairs (a, b), those that hold, pinned. keys: (id, keys), for each id all its keys; if given,
    rows of keys with more than CROWD rows outside their largest group meet only if they share a second key, and other links of those keys are lost. Without it none is.
    closer: (id, ...) of every id and a condition like near on its columns, which all links meet; pairs of the second round must meet it too, so that few of them are read that are no links.

    Comparing all pairs of a key would cost the square of its rows, so it goes in two rounds:
    1. Every row of a key is compared with one hub of that key; the links found give first groups. A key that holds
       copies of one thing, however many, is one group after this, and keys of two rows are settled.
    2. In every key that still has rows of several groups, the rows outside its largest group are compared with the rows of
       other groups; see cross_pairs for crowded keys.
    """
    shared = shared_postings(postings, info)
    side = lambda before: {c: F.col(before + c) for c in info}
    first = links(shared.where("id <> hub").where(near(side("hub_"), side(""))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    groups = pin(components(first), "first-groups")
    # A key of two rows has no other pair than its hub's.
    marked = shared.where("n_rows > 2").select("k", "id", *info).join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    opened = _open(marked)
    if closer:
        frame, condition = closer
        opened, coarse, own = opened.join(frame, "id"), near, [c for c in frame.columns if c != "id"]
        info, near = [*info, *own], lambda x, y: coarse(x, y) & condition(x, y)
    if keys is None:
        found = cross_pairs(opened, info, near)
    else:
        found = cross_pairs(opened.where(f"outside <= {CROWD}"), info, near).union(cross_pairs(_open(_narrowed(opened.where(f"outside > {CROWD}"), info, keys)), info, near))
    more = links(found.distinct())
    if more.isEmpty():
        return groups
    # The groups of the first round stand for their rows, so that only groups that the second round links are joined anew.
    first = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    between = pin(more.join(first("a"), "a", "left").join(first("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")), "group-links")
    merged = components(between).withColumnsRenamed({"id": "own", "component": "joined"})
    both = groups.join(merged, F.col("component") == F.col("own"), "full")
    return pin(both.select(F.coalesce("id", "own").alias("id"), F.coalesce("joined", "component").alias("component")), "groups")


def _open(postings: DataFrame) -> DataFrame:
    """The postings (k, component, ...) of keys with rows of several groups, with `most` (the key's largest group) and `outside` (rows outside it)."""
    sizes = postings.groupBy("k", "component").agg(F.count("*").alias("n"))
    keys = pin(sizes.groupBy("k").agg(F.max_by("component", "n").alias("most"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0"), "open-keys")
    return pin(postings.join(keys, "k"), "open-postings")


def _narrowed(postings: DataFrame, info: list[str], keys: DataFrame) -> DataFrame:
    """The postings with one key for each two keys that a row has, the first one of theirs."""
    names = ["id", "component", *info]
    crowded = postings.select("k", *names).join(keys, "id").select(F.col("k").alias("one"), *names, F.explode("keys").alias("two")).where("one <> two")
    return crowded.select(F.xxhash64(F.least("one", "two"), F.greatest("one", "two")).alias("k"), *names).dropDuplicates(["k", "id"])


def cross_pairs(postings: DataFrame, info: list[str], near: Callable) -> DataFrame:
    """Pairs (a, b) across groups in the same key: each row outside the key's largest group with every row of another group, once.

    A key with more than CROWD such rows is dealt: its rows outside the largest group, and all its rows, go by their ids into blocks of about CROWD, and each
    block of the one meets each of the other, so that no task holds a key. Nothing is left out; such a key costs the product of its groups.
    """
    names = ["id", "component", *info]
    dealt = lambda rows: F.greatest(F.ceil(F.sqrt(rows / CROWD)), F.lit(1)).cast("int")
    whole = postings.select("k", "most", *names, dealt(F.col("outside")).alias("parts"))
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = whole.where("component <> most").select("k", "most", *[F.col(c).alias(f"l_{c}") for c in names], block.alias("l_block"), every.alias("r_block"))
    right = whole.select("k", *[F.col(c).alias(f"r_{c}") for c in names], block.alias("r_block"), every.alias("l_block"))
    # Two rows outside the largest group meet on both sides; they count on one.
    once = (F.col("r_component") == F.col("most")) | (F.col("l_id") < F.col("r_id"))
    met = left.join(right, ["k", "l_block", "r_block"]).where((F.col("l_component") != F.col("r_component")) & once & near({c: F.col(f"l_{c}") for c in info}, {c: F.col(f"r_{c}") for c in info}))
    return met.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))
