"""Packing token sequences by shortest-pack-first over the length histogram (operator 8).

Documents are tokenised where they lie and cut into pieces of at most the sequence length. Only
the histogram of piece lengths, which has as many bins as a sequence has tokens, comes to the
driver. There the bins are placed from the longest to the shortest, each into the packs
with the most room left; packs that look alike are one pattern with a count, so the work depends
on the number of bins and not of pieces. Every pattern slot owns a run of ranks among the pieces
of its length, and pieces find their slot by rank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import pin, table, unit_interval

MAX_TOKENS = 4096
END_ID = 2
#: Words whose ids a worker keeps; when it has more it starts anew.
CACHE_WORDS = 250_000
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Ranks are counted inside buckets of about so many pieces.
BUCKET_ROWS = 20_000


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u012f\u0131-\u017f"
#: Runs of these alone, without the special tokens' and the elisions' signs, take the short way.
_PLAIN = re.compile("[\x21-\x26\x28-\x3b\x3d-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PART = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class PartIds(dict):
    """The ids of a part of a run that the tokenizer takes by itself: letters, a digit or signs."""

    def __init__(self, path: str):
        self.model, self.letter = _tokenizer(path).model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.letter.__getitem__, part.encode()))
        self[part] = ids = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
        return ids


class WordIds(dict):
    """The ids of each white-space-free run of bytes, as little-endian bytes of 32 bits each.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its runs put together; most runs, and more so their parts, are met many times.
    """

    def __init__(self, path: str):
        self.tokenizer, self.parts = _tokenizer(path), PartIds(path)

    def __missing__(self, word: bytes) -> bytes:
        run = word.decode()
        if _PLAIN.fullmatch(run):
            parts = _PART.findall(run.lower())
            ids = self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[p] for p in parts])
        else:
            ids = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        for kept in (self, self.parts):
            if len(kept) > CACHE_WORDS:
                kept.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each worker, kept from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document (doc_id, text): start, length, ids_crc32 and the document's doc_tokens.

    A document's ids and the id that ends it are cut every max_tokens. Null text: empty, so one piece of one id.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids = memoryview(words.of(text or "") + end)
                n = len(ids) // 4
                rows += [(doc_id, at, min(max_tokens, n - at), zlib.crc32(ids[4 * at : 4 * (at + max_tokens)]), n) for at in range(0, n, max_tokens)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, times), ...]), from a histogram of lengths.

    Lengths are placed from the longest down. A length goes to the pattern with the most room
    left; where only some of that pattern's packs are needed, it is split in two. A length that
    fits in no pack opens new ones.
    """
    room: list[tuple[int, int, int, tuple]] = []  # (-room left, tie, count, slots as a linked list)
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if room and -room[0][0] >= length:
                free, _, count, slots = heapq.heappop(room)
            else:
                free, count, slots = -max_tokens, left, ()
            # When every pack of the pattern can take several before the next roomier one is passed, they take them at once.
            below = -room[0][0] if room else 0
            times = max(1, min((-free - max(below, length - 1)) // length, left // count if count else 1))
            used = min(count, left // times)
            if used < count:
                tie += 1
                heapq.heappush(room, (free, tie, count - used, slots))
            left -= used * times
            tie += 1
            heapq.heappush(room, (free + length * times, tie, used, ((length, times), slots)))
    patterns = []
    for _, _, count, slots in sorted(room):
        flat = []
        while slots:
            flat.append(slots[0])
            slots = slots[1]
        patterns.append((count, flat[::-1]))
    return patterns


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each slot of each pattern: length, first rank among the pieces of that length, first sequence, times, offset in the sequence."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, slots in patterns:
        offset = 0
        for length, times in slots:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, times, offset))
            next_rank[length] = rank + count * times
            offset += length * times
        sequence += count
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "times": a[:, 3], "offset": a[:, 4]}


def ranked_by_length(parts: DataFrame, rows: int) -> DataFrame:
    """parts with `rank`, counted from 0 among the pieces of equal length, whatever share of them has one length."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    dealt = parts.withColumn("bucket", unit_interval(F.col("doc_id"), F.col("start"), F.col("ids_crc32")) % buckets)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return dealt.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def pack(parts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """parts (doc_id, start, length, ids_crc32, ...) with sequence_id and offset; parts should be pinned.

    Sequences hold at most max_tokens; in each, pieces lie without gaps from 0. Equal rows are
    pieces like others. An empty table: no rows.
    """
    bins = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # max_tokens rows at most
    slots = slot_table(shortest_pack_first({r.length: r.n for r in bins}, max_tokens))
    ranked = ranked_by_length(parts, sum(r.n for r in bins))
    # The slots follow from max_tokens bins, not from the number of pieces.
    held = parts.sparkSession.sparkContext.broadcast(slots)
    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id bigint, offset bigint"
    names = parts.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        span = np.int64(1) << 48  # ranks stay below it
        keys = s["length"] * span + s["rank"]
        for batch in batches:
            length, rank = batch.length.to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            i = np.searchsorted(keys, length * span + rank, side="right") - 1
            inside = rank - s["rank"][i]
            times = s["times"][i]
            batch["sequence_id"] = s["sequence"][i] + inside // times
            batch["offset"] = s["offset"][i] + inside % times * length
            yield batch[[*names, "sequence_id", "offset"]]

    return ranked.mapInPandas(place, schema)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces of docs with their place in the packed sequences."""
    return pack(pin(pieces(docs, tokenizer_path or tokenizer_file(), max_tokens), "pieces"), max_tokens)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pack": op8_pack}
