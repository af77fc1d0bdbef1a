"""Cross-tokenizer alignment by a dangling-suffix transducer (operator 12).

Two tokenizers cut the same bytes. The transducer reads both token sequences; its state is the side that leads and
the bytes of the leader's last token that the other side has not reached yet. The next token of the side behind
either shortens the residual or takes the lead with its own; an empty residual closes a group. Each step but a
group's first meets exactly the leader's last token, so the steps are the links. Transitions are kept by residual and
next token, as a state's own dictionary.

Counts of linked id pairs are corpus-wide. Pairs above a count that at most HOT_PAIRS pairs reach are looked up in a
sorted list in each task; the others, each of them rare, go through a join.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_columns, map_slices, pin, table, unpin, unused

#: Pairs that tasks look up by themselves, 12 bytes each.
HOT_PAIRS = 1 << 20
#: Transitions that a task keeps; it starts anew beyond them.
KEPT_TRANSITIONS = 1 << 20
#: Documents encoded at a time.
SLICE = 64
#: A pair of ids as one number: a * STRIDE + b.
STRIDE = 1 << 31

ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


class State(dict):
    """The side that leads (1: A, -1: B, 0: none) and its residual; as a dictionary, the next state by the other side's next token."""

    __slots__ = ("lead", "machine", "residual")

    def __init__(self, machine: Transducer, lead: int, residual: bytes):
        self.machine, self.lead, self.residual = machine, lead, residual

    def __missing__(self, token: int) -> State:
        machine, rest = self.machine, self.residual
        # With no side in the lead, A takes it.
        behind = -self.lead or 1
        own = (machine.bytes_a if behind == 1 else machine.bytes_b)[token]
        if len(own) > len(rest):
            after = machine.state(behind, own[len(rest) :]) if own.startswith(rest) else machine.differ
        elif rest.startswith(own):
            after = machine.state(self.lead, rest[len(own) :]) if len(rest) > len(own) else machine.start
        else:
            after = machine.differ
        self[token] = after
        machine.kept += 1
        return after


class Transducer:
    """States and transitions over the token bytes of two vocabularies."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes], limit: int = KEPT_TRANSITIONS):
        self.bytes_a, self.bytes_b, self.limit = bytes_a, bytes_b, limit
        self.forget()

    def forget(self) -> None:
        self.kept = 0
        self.start, self.differ = State(self, 0, b""), State(self, 0, b"")
        self.states: dict[tuple[int, bytes], State] = {}
        # Groups of one token a side, printed, by pair number.
        self.single: dict[int, str] = {}

    def state(self, lead: int, residual: bytes) -> State:
        key = (lead, residual)
        if key not in self.states:
            self.states[key] = State(self, lead, residual)
        return self.states[key]

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """The groups, each printed as `a1,a2|b1`, and the links as pair numbers; None if the bytes of the sides differ. No token is empty."""
        if self.kept > self.limit:
            self.forget()
        start, differ, single = self.start, self.differ, self.single
        i = j = 0
        groups, links = [], []
        try:
            while i < len(a):
                # A opens a group, and each later token meets the last one of the other side.
                x, y = a[i], b[j]
                i, j = i + 1, j + 1
                pair = x * STRIDE + y
                links.append(pair)
                if pair in single:
                    groups.append(single[pair])
                    continue
                now, p, q = start[x][y], i - 1, j - 1
                while now is not start:
                    if now.lead > 0:
                        y = b[j]
                        j += 1
                        now = now[y]
                    elif now is differ:
                        return None
                    else:
                        x = a[i]
                        i += 1
                        now = now[x]
                    links.append(x * STRIDE + y)
                groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
                if i - p == 1 == j - q:
                    single[pair] = groups[-1]
        except IndexError:
            return None
        return (groups, links) if j == len(b) else None


@lru_cache(1)
def _byte_tokenizer(path: str) -> tuple[Callable, list[bytes]]:
    """Ids of texts, and the bytes of each id, by a file of ranks: byte_bpe_50k.tiktoken is the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, sorted(ranks, key=ranks.get)


@lru_cache(1)
def _piece_tokenizer(path: str) -> tuple[Callable, list[bytes]]:
    """Ids of texts, and the bytes of each id, by a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    own = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return (lambda texts: model.encode(texts, num_threads=1)), own


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def _aligner(paths: tuple[str, str]) -> tuple[Callable[[list[str | None]], Iterator[tuple[list[int], list[int], list[str], list[int]]]], Transducer]:
    """A function from texts to ids of A and B, groups and links of each (empty where the joined bytes differ from space and text), and the transducer."""
    encode_a, bytes_a = _byte_tokenizer(paths[0])
    encode_b, bytes_b = _piece_tokenizer(paths[1])
    machine = Transducer(bytes_a, bytes_b)

    def aligned(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str], list[int]]]:
        for text, b in zip(texts, encode_b([t or "" for t in texts]), strict=True):
            a = encode_a(" " + text) if text else []
            # B's bytes are compared with A's on the way.
            found = machine.align(a, b) if a and b"".join([bytes_a[x] for x in a]) == b" " + text.encode() else None
            yield (a, b, *found) if found else ([], [], [], [])

    return aligned, machine


def token_groups(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, group (from 0), start and end (bytes of space and text), ids_a and ids_b of each group of each row.

    Null and empty texts, and those of which a side's bytes differ from space and text, have no groups. Rows that share a doc_id
    each have their own. Texts of any length; other columns are not read.
    """
    paths = vocabularies or vocabulary_files()

    def begin():
        aligned, machine = _aligner(paths)

        def work(keys: list, texts: list) -> list[tuple]:
            rows = []
            for key, (_, _, groups, _) in zip(keys, aligned(texts), strict=True):
                at = 0
                for k, group in enumerate(groups):
                    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
                    size = sum(len(machine.bytes_a[x]) for x in a)
                    rows.append((key, k, at, at + size, a, b))
                    at += size
            return rows

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), begin, "doc_id bigint, group bigint, start bigint, end bigint, ids_a array<int>, ids_b array<int>", SLICE)


def aligned_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, the counts and the groups' digest of each row, and its different linked pairs with the times they occur.

    Rows without tokens (see token_groups): zeros, '' for the digest, empty arrays.
    """
    paths = vocabularies or vocabulary_files()

    def begin():
        aligned, _ = _aligner(paths)

        def work(keys: pa.Array, texts: pa.Array) -> Iterator[list[pa.Array]]:
            counts, digests, pairs, times, upto = [], [], [], [], [0]
            for a, b, groups, links in aligned(texts.to_pylist()):
                digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                counts.append((len(a), len(b), len(groups), len(links)))
                own, n = np.unique(np.array(links, dtype=np.int64), return_counts=True)
                pairs.append(own)
                times.append(n.astype(np.int32))
                upto.append(upto[-1] + len(own))
            numbers = np.array(counts, dtype=np.int64).T
            offsets = pa.array(upto, pa.int32())
            yield [keys, *map(pa.array, numbers), pa.array(digests), pa.ListArray.from_arrays(offsets, np.concatenate(pairs)), pa.ListArray.from_arrays(offsets, np.concatenate(times))]

        return work

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), begin, f"doc_id bigint, {ALIGNED}", SLICE)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of all documents that hold it linked) and best (no pair of its id of B has more)."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("link.pairs", "link.times")
    counts = pin(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    b = (F.col("pair") % STRIDE).alias("b")
    # As many rows as the vocabulary of B has ids.
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), (counts.pair % STRIDE) == most.b).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot(counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least power of two that at most HOT_PAIRS pairs reach, and those pairs, their counts and whether they are best."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).collect())
    least, above = 64, 0
    while least and above + sizes.get(least - 1, 0) <= HOT_PAIRS:
        least -= 1
        above += sizes.get(least, 0)
    at_least = 1 << min(least, 62)
    rows = counts.where(F.col("n") >= at_least).orderBy("pair").toArrow()
    return at_least, *(rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))


def scored_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no pair of the same id of B exceeds), count_sum (of their pairs' counts) and groups_sha256 of each row."""
    spark = docs.sparkSession
    row = unused("row", docs)
    aligned = pin(aligned_documents(docs, vocabularies).withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = pin(pair_counts(aligned), "pair-best")
    least, *hot = _hot(counts)
    held = spark.sparkContext.broadcast(hot)

    def begin():
        pairs, counted, best = held.value

        def work(rows: pa.Array, own: pa.ListArray, times: pa.ListArray) -> Iterator[list[pa.Array]]:
            ends = np.asarray(own.offsets) - own.offsets[0].as_py()
            mine, n = own.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                found = pairs[at] == mine
                parts = [np.where(found & best[at], n, 0), np.where(found, n * counted[at], 0), ~found]
            else:
                parts = [np.zeros_like(n), np.zeros_like(n), np.ones(len(n), dtype=bool)]
            n_best, count_sum, upto = (np.concatenate([[0], np.cumsum(p)])[ends] for p in parts)
            offsets = pa.array(upto.astype(np.int32))
            yield [rows, pa.array(np.diff(n_best)), pa.array(np.diff(count_sum)), pa.ListArray.from_arrays(offsets, mine[parts[2]]), pa.ListArray.from_arrays(offsets, n[parts[2]])]

        return work

    summed = map_columns(aligned.select(row, "pairs", "times"), begin, f"{row} bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    summed = pin(summed.join(aligned.select(row, "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), row), "aligned-sums")
    unpin(aligned)
    rare = summed.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    more = rare.join(counts.where(F.col("n") < least), "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    total = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return summed.join(more, row, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned and scored."""
    return scored_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
