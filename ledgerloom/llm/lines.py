"""Fuzzy line dedup (operator 3).

Lines are normalised. The different words of each distinct line are dealt by their hashes to blocks, more blocks for longer lines,
and the SimHash of a block's words is that block of the line's signature. An edited word touches the block it leaves and
the one it enters, so, by the pigeonhole principle, lines with fewer edits than half their blocks agree in a block: every
block is a key. Lines that meet in a key and whose SimHashes of all words are near are verified by edit similarity and
joined to groups. Of each group the first occurrence stays and the others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, map_columns, map_slices, pin, scratch, table, unpin, unused
from ledgerloom.llm.groups import grouped
from ledgerloom.llm.shingles import PIECE_BYTES, mixed, words

#: Lines with fewer words (headings, greetings) are left alone.
MIN_WORDS = 5
#: Lines with this many different words or more, up to the next number: blocks of the signature, and words that a block needs to be a key,
#: as a common word or two say little. Near a number, lines have both signatures.
LEVELS = [(MIN_WORDS, 4, 1), (12, 8, 2), (48, 16, 3), (192, 24, 3)]
#: Numbers of words of like lines differ by at most this factor, as their lengths do.
REACH = 1.25
#: Bits in which the SimHashes of like lines' words differ at most. See the README for the recall.
MAX_BITS = 18
#: Hundredths of the different words of the longer line that like lines share at least; SimHashes that near by chance are told apart by it.
SHARED_PERCENT = 50
#: Lines are alike when at most the rest of this many hundredths of the longer one's characters has to be edited.
MIN_PERCENT = 80
#: Longs of 64 bits in which a line's words are marked, to see before it is read again whether it can share words enough with another.
MARKS = 4
_MARKS = [f"mark_{i}" for i in range(MARKS)]
#: Columns of a distance table after which it is seen whether any way through it stays below the limit.
LOOK = 64
#: Pairs of lines that a task compares.
TASK_PAIRS = 4000
#: The column that counts the lines taken out; one of docs with that name gives way to it.
REMOVED = "removed_lines"
#: Bits of a word's hash; the line's number takes the rest of 64.
HASH_BITS = 44
#: Words whose bits are summed up at a time.
SUM_WORDS = 1 << 16
#: A byte's normal form: digits are 0, ASCII marks and white space but for the line end are spaces.
_FORM = bytes(b if b >= 0x80 or b == 10 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))


def translated(text: str) -> bytes:
    """A text in lower case with each byte in normal form; runs of spaces stay."""
    return text.lower().encode().translate(_FORM)


def simhashes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, whether most of a line's word hashes have it; as signed longs. Lines lie one after another, with `sizes` words each.

    Bits are counted in the bytes of eight numbers a word, over runs of at most 255 words so that no byte runs over.
    """
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    begin = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    end = np.append(begin[1:], len(words))
    counts, at = np.zeros((len(begin), 64), dtype=np.uint8), 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + SUM_WORDS)))
        lanes = np.unpackbits(words[begin[at] : end[to - 1]].view(np.uint8)).view(np.uint64).reshape(-1, 8)
        counts[at:to] = np.add.reduceat(lanes, begin[at:to] - begin[at], axis=0).view(np.uint8).reshape(-1, 64)
        at = to
    total = np.add.reduceat(counts, first, axis=0, dtype=np.int64) if len(begin) > len(sizes) else counts.astype(np.int16)
    return np.packbits(2 * total > sizes[:, None], axis=1).view(np.int64)[:, 0]


def simhash(words: np.ndarray) -> int:
    """The SimHash of one line."""
    return int(simhashes(words, np.array([len(words)]))[0])


def distinct_words(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each line's distinct words, sorted; the hash has HASH_BITS bits and so rises from a line's first block to its last."""
    both = np.unique(line.astype(np.uint64) << np.uint64(HASH_BITS) | mixed(h) >> np.uint64(64 - HASH_BITS))
    return (both >> np.uint64(HASH_BITS)).astype(np.int64), both & np.uint64((1 << HASH_BITS) - 1)


def block_keys(line: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of each block that has words enough, of all lines; line and h: distinct_words, sizes: how many each line has."""
    lines, keys = [], []
    for n, (least, blocks, enough) in enumerate(LEVELS):
        below = LEVELS[n + 1][0] if n + 1 < len(LEVELS) else np.inf
        own = (((sizes * REACH >= least) | (n == 0)) & (sizes < below * REACH))[line]
        if not own.any():
            continue
        block = line[own] * blocks + ((h[own] >> np.uint64(HASH_BITS - 24)).astype(np.int64) * blocks >> 24)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        held = np.diff(np.append(starts, len(block)))
        kept = held >= enough
        if not kept.any():
            continue
        bits = simhashes(mixed(h[own])[np.repeat(kept, held)], held[kept]).view(np.uint64)
        block = block[starts[kept]]
        lines.append(block // blocks)
        keys.append(mixed(bits + mixed((block % blocks + 64 * n + 1).astype(np.uint64))).view(np.int64))
    return (np.concatenate(lines), np.concatenate(keys)) if lines else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_marks(line: np.ndarray, h: np.ndarray, lines: int) -> list[np.ndarray]:
    """MARKS columns of signed longs: the bits of each line's words, one for each; line and h: distinct_words."""
    bits = np.zeros(lines * MARKS * 64, dtype=bool)
    bits[line * MARKS * 64 + h.astype(np.int64) % (MARKS * 64)] = True
    longs = np.packbits(bits).view(np.int64).reshape(lines, MARKS)
    return [np.ascontiguousarray(longs[:, i]) for i in range(MARKS)]


def may_share(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether two lines may share SHARED_PERCENT hundredths of the longer one's words: those that a line has alone leave no more bits alone than there are of them."""
    shared = F.greatest(x["n_words"], y["n_words"]) * SHARED_PERCENT
    alone = lambda x, y: sum((F.bit_count(x[f"mark_{i}"].bitwiseAND(F.bitwise_not(y[f"mark_{i}"]))) for i in range(1, MARKS)), F.bit_count(x["mark_0"].bitwiseAND(F.bitwise_not(y["mark_0"]))))
    return ((x["n_words"] - alone(x, y)) * 100 >= shared) & ((y["n_words"] - alone(y, x)) * 100 >= shared)


class Lines:
    """The lines of texts that were joined by line ends: words, and for each line its hash, number of words and length in normal form."""

    def __init__(self, raw: bytes):
        self.raw = raw
        data = np.frombuffer(raw, dtype=np.uint8)
        self.begin, self.end, self.h = words(raw)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        last = np.searchsorted(self.begin, ends)
        self.first = np.append(0, last[:-1])
        self.n_words = last - self.first
        self.line = np.repeat(np.arange(len(ends)), self.n_words)
        rank = np.arange(len(self.h)) - np.repeat(self.first, self.n_words)
        total = np.append(np.uint64(0), np.cumsum(mixed(self.h + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        self.hash = mixed(total[last] - total[self.first]).view(np.int64)
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        inside = np.append(0, np.cumsum(chars[self.end] - chars[self.begin]))
        self.size = inside[last] - inside[self.first] + np.maximum(self.n_words - 1, 0)

    def form(self, line: int) -> str:
        a = self.first[line]
        return b" ".join(self.raw[self.begin[a] : self.end[a + self.n_words[line] - 1]].split()).decode() if self.n_words[line] else ""


def line_pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, Lines]]:
    """The lines of the texts in runs of about PIECE_BYTES: number of the text, number of the line in it, and the lines."""
    which, number, held, size = [], [], [], 0
    for at, text in enumerate(texts):
        for n, line in enumerate(translated(text or "").split(b"\n")):
            which.append(at)
            number.append(n)
            held.append(line)
            size += len(line) + 1
            if size > PIECE_BYTES:
                yield np.array(which), np.array(number), Lines(b"\n".join(held))
                which, number, held, size = [], [], [], 0
    if held:
        yield np.array(which), np.array(number), Lines(b"\n".join(held))


def shared_start(x: str, y: str) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edits_at_most(x: str, y: str) -> int:
    """A number of edits that turn x into y, not always the least: runs of words are replaced between the next words in common."""
    a, b = [w + " " for w in x.split(" ")], [w + " " for w in y.split(" ")]
    i = j = edits = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(((i + n, j + m - n) for m in range(1, 7) for n in range(m + 1) if i + n < len(a) and j + m - n < len(b) and a[i + n] == b[j + m - n]), (i + 1, j + 1))
        edits += max(sum(map(len, a[i:p])), sum(map(len, b[j:q])))
        i, j = p, q
    return edits + max(sum(map(len, a[i:])), sum(map(len, b[j:])))


def within_edits(x: str, y: str, limit: int) -> bool:
    """Whether at most `limit` edits of a character turn x into y; a whole column of the distance table is held as bits of one number."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > limit:
        return False
    same = shared_start(x, y)
    x, y = x[same:], y[same:]
    same = shared_start(x[::-1], y[::-1])
    x, y = x[: len(x) - same], y[: len(y) - same]
    if len(y) <= limit or edits_at_most(x, y) <= limit:
        return True
    if not x:
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    whole, top, distance = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    more, fewer = whole, 0  # rows where the distance is one above, one below the row before
    for left, c in zip(range(len(y) - 1, -1, -1), y, strict=True):
        equal = where.get(c, 0)
        level = (((equal & more) + more) ^ more) | equal | fewer
        up, down = fewer | (whole & ~(level | more)), more & level
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - left > limit:
            return False
        up = up << 1 | 1
        more, fewer = (down << 1 | ~(level | up)) & whole, up & level & whole
        if left and left % LOOK == 0 and least_distance(more, fewer, len(x), len(y) - left, left) > limit:
            return False
    return distance <= limit


def least_distance(more: int, fewer: int, rows: int, column: int, left: int) -> int:
    """The least distance that any way through a column of the distance table can end with: what it has cost, and the characters that one side has left over."""
    steps = [np.unpackbits(np.frombuffer(bits.to_bytes(-(-rows // 8), "little"), dtype=np.uint8), count=rows, bitorder="little").astype(np.int32) for bits in (more, fewer)]
    cost = column + np.append(0, np.cumsum(steps[0] - steps[1]))
    return int((cost + np.abs(np.arange(rows, -1, -1) - left)).min())


def like(x: str, y: str) -> bool:
    """Whether two normal forms share SHARED_PERCENT hundredths of their words and have an edit similarity of MIN_PERCENT hundredths."""
    a, b = set(x.split(" ")), set(y.split(" "))
    return 100 * len(a & b) >= SHARED_PERCENT * max(len(a), len(b)) and within_edits(x, y, max(len(x), len(y)) * (100 - MIN_PERCENT) // 100)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, h, sim, size, n_words, mark_*, keys) of every line of docs (doc_id, text) with MIN_WORDS words: hash, SimHash and length of its normal form, number and marks of its different words, block keys."""

    def start():
        def read(ids: pa.Array, hashes: pa.Array, texts: pa.Array) -> Iterator[list[pa.Array]]:
            for which, number, found in line_pieces(texts.to_pylist()):
                kept = np.flatnonzero(found.n_words >= MIN_WORDS)
                if not len(kept):
                    continue
                own = (found.n_words >= MIN_WORDS)[found.line]
                line, h = distinct_words(found.h[own], np.repeat(np.arange(len(kept)), found.n_words[kept]))
                sizes = np.bincount(line, minlength=len(kept))
                of, keys = block_keys(line, h, sizes)
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(kept)))).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(of, kind="stable")]))
                row = pa.array(which[kept])
                yield [ids.take(row), hashes.take(row), *map(pa.array, (number[kept], found.hash[kept], simhashes(mixed(h), sizes), found.size[kept], sizes, *word_marks(line, h, len(kept)))), held]

        return read

    return map_columns(docs.select("doc_id", F.xxhash64("text"), "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, line int, h bigint, sim bigint, size int, n_words int, {', '.join(f'{m} bigint' for m in _MARKS)}, keys array<bigint>")


def line_groups(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h, group) for lines h that are alike: groups of normal forms joined by verified links. A line without links has no row.

    distinct: (h, sim, size, n_words, mark_*, keys, doc_id) of the distinct lines, with a document of docs that has the line.
    """
    postings = distinct.select(F.explode("keys").alias("k"), F.col("h").alias("id"), "sim", "size")
    near = lambda x, y: (F.bit_count(x["sim"].bitwiseXOR(y["sim"])) <= MAX_BITS) & (F.least(x["size"], y["size"]) * 100 >= F.greatest(x["size"], y["size"]) * MIN_PERCENT)

    def forms(ids: DataFrame) -> DataFrame:
        """(id, form) of lines: a document of each is read again."""
        places = pin(distinct.join(ids.withColumnRenamed("id", "h"), "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("wanted")), "places")  # one document's lines

        def start():
            def pick(texts: list, wanted: list) -> list[tuple]:
                wanted, rows = [set(w) for w in wanted], {}
                for which, _, found in line_pieces(texts):
                    for i, (at, h) in enumerate(zip(which.tolist(), found.hash.tolist(), strict=True)):
                        if h in wanted[at]:
                            rows[h] = found.form(i)
                return list(rows.items())

            return pick

        # Never broadcast, so that small inputs have the plan that large ones need.
        met = docs.select("doc_id", "text").join(places.hint("merge"), "doc_id").select("text", "wanted")
        return map_slices(met, start, "id bigint, form string").dropDuplicates(["id"])

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pin(pairs, "line-pairs")
        texts = pin(forms(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "forms")
        # Pairs are few bytes and much work, so their number says how many tasks compare them.
        tasks = -(-pairs.count() // TASK_PAIRS)
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("form").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("form").alias("y")), "b").repartition(max(tasks, 1), "a", "b")

        @F.pandas_udf("boolean")
        def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for xs, ys in batches:
                yield pd.Series([like(x, y) for x, y in zip(xs, ys, strict=True)], dtype=bool)
            give_back()

        # Said to give other results each time, or the filter would go below the exchange that deals the pairs.
        alike = alike.asNondeterministic()
        held = pin(both.where(alike("x", "y")).select("a", "b"), "links")
        unpin(texts)
        return held

    groups = grouped(postings, ["sim", "size"], near, links, closer=(distinct.select(F.col("h").alias("id"), "n_words", *_MARKS), may_share))
    return groups.select(F.col("id").alias("h"), F.col("component").alias("group"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines): the numbers of the lines that repeat an earlier one, by (doc_id, line, text_hash), in the same or another row."""
    described = pin(line_rows(docs.where("doc_id is not null")), "lines")
    # The distinct lines; a document that has the line gives its text again.
    distinct = pin(described.groupBy("h").agg(*[F.first(c).alias(c) for c in ("sim", "size", "n_words", *_MARKS, "keys")], F.min("doc_id").alias("doc_id")), "distinct-lines")
    # Of the rest only the places are kept on disk.
    place = ["doc_id", "line", "text_hash"]
    occurrences = pin(described.select(*place, "h"), "occurrences")
    unpin(described)
    grouped_as = occurrences.join(line_groups(docs, distinct), "h", "left").select(*place, F.coalesce("group", "h").alias("group"))
    # Written, so that the join reads plain exchanges, in which Spark splits hot groups.
    firsts = pin(grouped_as.groupBy("group").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    again = grouped_as.join(firsts, "group").where(~F.struct(*place).eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))  # one document's lines


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs' rows and columns, with each line that repeats an earlier one taken out of text, and `removed_lines`.

    Lines are alike when their normal forms are equal, or when they agree in a block, their SimHashes differ in at most MAX_BITS bits, they share SHARED_PERCENT hundredths of their words and their edit similarity is at least MIN_PERCENT hundredths; groups are transitive and the first occurrence by (doc_id, line) stays.
    Lines of under MIN_WORDS words stay. Null and empty texts stay as they are. Rows that share doc_id and text count as one document;
    rows that share a doc_id alone are told apart by their texts. Rows without one take no part and keep all their lines.
    """
    removed, text_hash = unused("removed", docs), unused("text_hash", docs)
    with scratch():
        gone = pin(repeated_lines(docs.select("doc_id", "text")), "repeated-lines", keep=True)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lines in batches:
            out = []
            for text, numbers in zip(texts, lines, strict=True):
                if text is not None:
                    numbers = set(numbers.tolist())
                    text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in numbers])
                out.append(text)
            yield pd.Series(out, dtype=object)
        give_back()

    gone = gone.withColumnsRenamed({"lines": removed, "text_hash": text_hash})
    met = docs.withColumn(text_hash, F.xxhash64("text")).join(gone.hint("merge"), ["doc_id", text_hash], "left")
    touched = F.col(removed).isNotNull() & F.col("text").isNotNull()
    text = F.when(touched, cut(F.when(touched, F.col("text")), removed)).otherwise(F.col("text"))
    return met.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c != REMOVED], F.coalesce(F.size(removed), F.lit(0)).alias(REMOVED))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """docs without repeated lines and with docs' columns; n_chars is counted again, and documents of which only white space is left go."""
    own = unused("own", docs)
    out = without_repeats(docs.withColumnRenamed(REMOVED, own))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(own).alias(c) if c == REMOVED else F.col(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "removed_lines", F.size(F.split("text", "\n", -1)).alias("kept_lines"), "text")


QUERIES = {"op3_line_dedup": op3_line_dedup}
