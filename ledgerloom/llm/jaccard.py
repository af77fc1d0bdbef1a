"""N-gram Jaccard join by signature trees (operator 10).

Texts become sets of word shingles; equal sets are one class, and only classes are compared. Two
sets above the threshold must share one of the shingles that come first in a common order, so
those are the keys under which classes meet. The order puts shingles that many documents have last; how many have
them is counted over all documents in a table of fixed size, and the order changes the cost alone, never the links.

The rows of a key lie in blocks by size, and each block is a signature tree: a node holds the OR of the token bitmaps
below it and their range of set sizes. Dual traversal from the roots opens two nodes only when some pair below them could
overlap enough; the pairs of leaves that it reaches are the candidates, and no other way makes any. They are verified on the sets themselves, and
links are joined to groups.

Copies by the thousand would make all their pairs, so traversal goes in two rounds. In the first, rows that a traversal has
already tied together are not paired again, so a tree gives fewer pairs than it has rows. What these pairs prove makes first
groups; the second round opens whatever could still tie rows of different groups. No link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, give_back, map_slices, pin, scratch, table, unpin, unused
from ledgerloom.llm.groups import components, shared_postings
from ledgerloom.llm.shingles import shingle_sets

WORDS, PERCENT = 4, 85
#: Cells of the table that counts the documents of a shingle; chunks of it are summed up apart.
COUNT_BITS, CHUNKS = 20, 16
#: Bits of a token bitmap, children of a node, rows that a block holds about (a tree of its own under the key's root).
BITMAP_BITS, FAN, BLOCK = 4096, 8, 512
#: Pairs of nodes whose bitmaps are compared at a time.
STEP = 1 << 13


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """For each cell, how many (document, shingle) pairs of all docs hash to it; 2^COUNT_BITS numbers come to the driver."""
    size = 1 << COUNT_BITS
    packed = lambda cells: np.minimum(cells, (1 << 32) - 1).astype(np.uint32).tobytes()  # noqa: E731  a cell stays at its highest number

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for s in shingle_sets(batch.text.tolist(), words):
                np.add.at(cells, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        yield pd.DataFrame({"chunk": range(CHUNKS), "cells": [packed(p) for p in cells.reshape(CHUNKS, -1)]})
        del cells
        give_back()

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, dtype=np.uint32) for c in rows.cells], axis=0, dtype=np.int64)
        return pd.DataFrame({"chunk": [key[0]], "cells": [packed(total)]})

    # Tables of a few tasks at a time are added up before all meet.
    parts = docs.select("text").mapInPandas(count, "chunk int, cells binary").withColumn("part", F.spark_partition_id() % 16)
    added = parts.groupBy("chunk", "part").applyInPandas(lambda key, rows: add(key, rows), "chunk int, cells binary")
    rows = added.groupBy("chunk").applyInPandas(add, "chunk int, cells binary").collect()
    cells = np.zeros((CHUNKS, size // CHUNKS), dtype=np.int64)
    for r in rows:
        cells[r.chunk] = np.frombuffer(r.cells, dtype=np.uint32)
    return cells.reshape(-1)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The token bitmap of a set: one bit for each shingle, by its lowest bits."""
    bits = np.zeros(BITMAP_BITS, dtype=np.uint8)
    bits[(shingles & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def described(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, id (a hash of the set), prefix (the shingles that route it), its least shingle and token bitmap of each row."""
    held = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))  # 2^COUNT_BITS numbers

    def start():
        often = held.value

        def describe(ids: list, hashes: list, texts: list) -> list[tuple]:
            rows = []
            for doc_id, text_hash, s in zip(ids, hashes, shingle_sets(texts, words), strict=True):
                n = len(s)
                first = s[np.lexsort((s, often[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))[: n - (percent * n + 99) // 100 + 1 if n else 0]]
                rows.append((doc_id, text_hash, n, set_id(s), first.view(np.int64), int(s[:1].view(np.int64).sum()), bitmap(s).tobytes()))
            return rows

        return describe

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), start, "doc_id bigint, text_hash bigint, n_shingles bigint, id bigint, prefix array<bigint>, least bigint, bitmap binary")


def set_id(shingles: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Level:
    """The nodes of one level of a tree: OR of the bitmaps, range of sizes, most shingles over bits, and the group if all below are of one (else -1)."""

    def __init__(self, maps: np.ndarray, low: np.ndarray, high: np.ndarray, over: np.ndarray, groups: np.ndarray):
        self.maps, self.low, self.high, self.over, self.groups = maps, low, high, over, groups

    def above(self) -> Level:
        at = np.arange(0, len(self.low), FAN)
        least, most = np.minimum.reduceat(self.groups, at), np.maximum.reduceat(self.groups, at)
        return Level(
            np.bitwise_or.reduceat(self.maps, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.over, at), np.where(least == most, least, -1)
        )


class Tree:
    """A block of rows as leaves, near ones side by side, with levels of nodes up to one root. groups: numbers from 0, for each row."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray, least: np.ndarray):
        order = np.lexsort((ids, least))
        self.ids, sizes, maps = ids[order], sizes[order], maps[order]
        self.levels = [Level(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), groups[order])]
        while len(self.levels[-1].low) > 1:
            self.levels.append(self.levels[-1].above())


def open_pairs(x: Level, y: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes (i of x, j of y) could hold a pair of sets in different groups that reaches the threshold.

    Shared shingles lie on common bits; those that share a bit with another of their set are at most as many as the set has
    shingles over bits. Sets of sizes a and b that reach the threshold share at least percent / (100 + percent) of a + b.
    """
    keep = (100 * x.high[i] >= percent * y.low[j]) & (100 * y.high[j] >= percent * x.low[i]) & ((x.groups[i] != y.groups[j]) | (x.groups[i] < 0))
    near = np.flatnonzero(keep)
    for at in range(0, len(near), STEP):
        part = near[at : at + STEP]
        a, b = i[part], j[part]
        common = np.bitwise_count(x.maps[a] & y.maps[b]).sum(axis=1, dtype=np.int64) + np.minimum(x.over[a], y.over[b])
        keep[part] = (100 + percent) * common >= percent * (x.low[a] + y.low[b])
    return keep


def tree_pairs(a: Tree, b: Tree, percent: int, spanning: bool = False) -> list[tuple[int, int]]:
    """Pairs of leaves of two trees (or of one with itself) in different groups that could reach the threshold, by dual traversal from the roots.

    spanning: leaves that pairs given before tie together give no more pairs.
    """
    same = a is b
    x, y = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        kept = open_pairs(a.levels[x], b.levels[y], i, j, percent)
        i, j = i[kept], j[kept]
        if x == y == 0 or not len(i):
            break
        # The deeper tree goes down alone until both stand on one level.
        down = np.arange(FAN)
        if same or x == y:
            i, j = (i[:, None, None] * FAN + down[:, None]) + 0 * down, (j[:, None, None] * FAN + down) + 0 * down[:, None]
            x, y = x - 1, y - 1
        elif x > y:
            i, j, x = i[:, None] * FAN + down, j[:, None] + 0 * down, x - 1
        else:
            i, j, y = i[:, None] + 0 * down, j[:, None] * FAN + down, y - 1
        i, j = i.reshape(-1), j.reshape(-1)
        there = (i < len(a.levels[x].low)) & (j < len(b.levels[y].low))
        if same:
            there &= (i < j) if x == 0 else (i <= j)
        i, j = i[there], j[there]
    if same:
        i, j = i[i < j], j[i < j]
    else:
        i, j = i[a.ids[i] != b.ids[j]], j[a.ids[i] != b.ids[j]]
    if spanning and len(i):
        i, j = spanning_pairs(i, j, len(a.ids), 0 if same else len(a.ids), len(b.ids))
    u, v = a.ids[i], b.ids[j]
    return list(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))


def spanning_pairs(i: np.ndarray, j: np.ndarray, n: int, shift: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, in the order of i, those that tie parts together which are not tied yet. j's numbers begin at shift."""
    tied = np.arange(shift + max(n, m) if shift else n)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    kept = []
    for at, to in zip(starts, np.append(starts[1:], len(i)), strict=True):
        own, others = tied[i[at]], tied[j[at:to] + shift]
        new, where = np.unique(others, return_index=True)
        fresh = new != own
        if fresh.any():
            kept.append(at + where[fresh])
            tied[np.isin(tied, new)] = own
    kept = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
    return i[kept], j[kept]


def size_class(n: str, percent: int):
    """Sets that may reach the threshold are of one class or of neighbouring ones."""
    return F.floor(F.log(F.greatest(F.col(n), F.lit(1))) / F.log(F.lit(100 / percent)) - 1e-9).cast("int")


def tree_candidates(rows: DataFrame, percent: int, first_round: bool) -> DataFrame:
    """Candidate pairs (a, b) across groups in each key, by trees over rows (k, id, n, least, bitmap, component).

    A key's rows lie in blocks of about BLOCK of one size class, dealt by a hash, so that no task sees a whole key. Headers (root
    bitmap, sizes, groups) of a key's blocks meet; only pairs of blocks whose roots could hold a pair get their rows. In the first
    round a block meets itself and the next ones alone, and pairs span what they tie.
    """
    rows = rows.withColumn("class", size_class("n", percent))
    counted = pin(rows.groupBy("k", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "block-counts")
    dealt = rows.join(counted, ["k", "class"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # About BLOCK rows each.
    blocks = dealt.groupBy("k", "class", "block").agg(F.first("blocks").alias("blocks"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.collect_list(F.struct("id", "n", "least", "bitmap", "component")).alias("rows"))

    def tree(rows, groups: dict) -> Tree:
        return Tree(
            np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64), np.stack([np.frombuffer(r["bitmap"], dtype=np.uint64) for r in rows]),
            np.array([groups.setdefault(r["component"], len(groups)) for r in rows], dtype=np.int64), np.array([r["least"] for r in rows], dtype=np.int64),
        )

    def alone():
        def traverse(rows: list) -> list[tuple]:
            a = tree(rows[0], {})
            return tree_pairs(a, a, percent, first_round)

        return traverse

    def two():
        def traverse(low: list, high: list) -> list[tuple]:
            groups: dict = {}
            return tree_pairs(tree(low[0], groups), tree(high[0], groups), percent, first_round)

        return traverse

    def head():
        def root(keys: list, classes: list, numbers: list, blocks: list, c0: list, c1: list, rows: list) -> list[tuple]:
            top = tree(rows[0], {}).levels[-1]
            return [(keys[0], classes[0], numbers[0], blocks[0], c0[0], c1[0], int(top.low[0]), int(top.high[0]), int(top.over[0]), top.maps[0].tobytes())]

        return root

    def roots():
        at = np.zeros(1, dtype=np.int64)

        def level(h: dict) -> Level:
            number = lambda c: np.array([h[c]], dtype=np.int64)
            return Level(np.frombuffer(h["root"], dtype=np.uint64).reshape(1, -1), number("low"), number("high"), number("over"), np.full(1, -1))

        def test(keys: list, lows: list, highs: list) -> list[tuple]:
            kept = [(k, a, b) for k, a, b in zip(keys, lows, highs, strict=True) if open_pairs(level(a), level(b), at, at, percent)[0]]
            return [(k, a["class"], a["block"], b["class"], b["block"]) for k, a, b in kept]

        return test

    blocks = pin(blocks, "tree-blocks")
    # A block with itself, and then pairs of blocks, which only keys with more than one have.
    own = map_slices(blocks.where("size(rows) > 1 and c0 <> c1").select("rows"), alone, "a bigint, b bigint", 1)
    many = blocks.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    names = "class int, block int, blocks bigint, c0 bigint, c1 bigint, low bigint, high bigint, over bigint, root binary"
    headers = pin(map_slices(blocks.join(many, "k", "left_semi").select("k", "class", "block", "blocks", "c0", "c1", "rows"), head, f"k bigint, {names}", 1), "tree-headers")
    left, right = (headers.select("k", F.struct(*headers.columns[1:]).alias(s)) for s in ("l", "r"))
    same, fewest = F.col("l.class") == F.col("r.class"), F.least("l.blocks", "r.blocks")
    later = (same & (F.col("l.block") < F.col("r.block"))) | (F.col("l.class") + 1 == F.col("r.class"))
    close = (same & (F.col("l.block") + 1 == F.col("r.block"))) | (~same & (F.pmod("l.block", fewest) == F.pmod("r.block", fewest)))
    of_one = (F.col("l.c0") == F.col("l.c1")) & (F.col("r.c0") == F.col("r.c1")) & (F.col("l.c0") == F.col("r.c0"))
    met = left.join(right, "k").where((later & close if first_round else later) & ~of_one)
    met = pin(map_slices(met.select("k", "l", "r"), roots, "k bigint, l_class int, l_block int, r_class int, r_block int"), "tree-pairs")
    side = lambda s: blocks.select("k", F.col("class").alias(f"{s}_class"), F.col("block").alias(f"{s}_block"), F.col("rows").alias(f"{s}_rows"))
    both = met.join(side("l"), ["k", "l_class", "l_block"]).join(side("r"), ["k", "r_class", "r_block"]).select("l_rows", "r_rows")
    return own.union(map_slices(both, two, "a bigint, b bigint", 1)).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets (id, items) reach the threshold."""
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(both * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b")


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Rows link when their shingle sets' intersection is at least percent hundredths of their union. Null
    or empty text: no shingles, linked with nothing. Equal rows share a component. A null
    doc_id takes part, but only a group without any other id gets a null component.
    """
    return jaccard_labels(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def jaccard_labels(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of jaccard_groups with text_hash (xxhash64 of the text) and group, which tell apart rows and groups that share a doc_id."""
    with scratch():
        return pin(_jaccard_labels(docs.select("doc_id", "text"), words, percent), "groups", keep=True)


def _jaccard_labels(docs: DataFrame, words: int, percent: int) -> DataFrame:
    base = pin(described(docs, shingle_counts(docs, words), words, percent).withColumn("id", F.when(F.col("n_shingles") == 0, F.xxhash64(F.lit("empty"), "doc_id")).otherwise(F.col("id"))), "sets")
    # Equal sets have one id; one copy gives the class's keys and its bitmap.
    classes = pin(base.groupBy("id").agg(F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("least").alias("least"), F.first("bitmap").alias("bitmap"), F.min("doc_id").alias("doc_id")), "classes")
    labels = pin(base.select("doc_id", "text_hash", "n_shingles", "id"), "labels")
    unpin(base)
    shared = shared_postings(classes.select(F.explode("prefix").alias("k"), "id", "n"), ["n"], f"n_rows > 2 or low_n * 100 >= high_n * {percent}")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pin(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sources = pin(classes.join(ids, "id", "left_semi").select("doc_id").distinct(), "set-sources")

        def start():
            def sets(texts: list) -> list[tuple]:
                # The id is taken from the set again, so that rows which share a doc_id are told apart.
                return [(set_id(s), s.view(np.int64)) for s in shingle_sets(texts, words)]

            return sets

        again = docs.select(F.col("doc_id").cast("long").alias("key"), "text").join(sources, F.col("key").eqNullSafe(F.col("doc_id")), "left_semi")
        sets = pin(map_slices(again.select("text"), start, "id bigint, items array<bigint>").join(ids, "id", "left_semi").dropDuplicates(["id"]), "verified-sets")
        found = pin(verified(pairs, sets, percent), "links")
        unpin(sets, pairs)
        return found

    def rows(postings: DataFrame) -> DataFrame:
        return postings.join(classes.select("id", "n", "least", "bitmap"), "id")

    first = links(tree_candidates(rows(shared.select("k", "id").withColumn("component", F.col("id"))), percent, True))
    groups = pin(components(first), "first-groups")
    marked = shared.where("n_rows > 2").select("k", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = marked.groupBy("k").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("k")
    left = pin(marked.join(pin(several, "open-keys"), "k", "left_semi"), "open-postings")
    more = links(tree_candidates(rows(left), percent, False))
    if not more.isEmpty():
        # The groups of the first round stand for their links.
        groups = pin(components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "all-groups")
    labelled = labels.join(groups, "id", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "id").alias("group"))
    names = pin(labelled.groupBy("group").agg(F.min("doc_id").alias("component_id")), "names")
    return labelled.join(names, "group").select("doc_id", "text_hash", "n_shingles", "group", "component_id")


def distinct_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each group of linked rows the one with the smallest (doc_id, text_hash) stays, null ids last.

    Rows are told apart by doc_id and text, so different texts under one doc_id are different rows; of rows equal in both, one
    stays. Rows without words (null and empty texts among them) are linked with nothing, and all of them stay. All columns of docs are kept.
    """
    text_hash = unused("text_hash", docs)
    rows = docs.withColumn(text_hash, F.xxhash64("text"))
    labels = jaccard_labels(docs, words, percent).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash")))
    stays = labels.groupBy("group").agg(first.alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = rows.where(has_words).join(stays.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(text_hash) == F.col("kept_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", text_hash]).select(*docs.columns).unionByName(docs.where(~has_words))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group that links of 85 % over shingles of four words put them in."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
