"""Pages, lines, scans, provenance, chunks and retrieval as DataFrame operators."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULTS
from ledgerloom.functions.text import strip_white
from ledgerloom.operators.statements import settled

#: Patterns of text that tries to give instructions. The odd class [e|er] is meant.
INJECTION_PATTERNS = (
    r"ignor[e|er]\w* (les |ces )?(consignes|instructions)",
    r"tu es (maintenant|d[eé]sormais)",
    r"nouvelle (instruction|consigne)",
    r"system\s*:",
    r"\bassistant\s*:",
    r"r[eé]ponds? (uniquement |toujours )?(avec|par)",
    r"ne tiens pas compte",
    r"###\s*(instruction|system|override)",
)


def injection_scan(df: DataFrame, text: Column, patterns: tuple[str, ...] = INJECTION_PATTERNS) -> DataFrame:
    """df with suspicious and the matched patterns; the text stays as it is."""
    found = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(str(i))) for i, p in enumerate(patterns)]))
    return df.withColumns({"suspicious": F.size(found) > 0, "matched": F.array_join(found, "|")})


def page_text(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, n_pages, tagged): the pages of a document under their numbers, in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))  # a document's pages
    tagged = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("[PAGE "), x["p"].cast("string"), F.lit("]\n"), x["t"])), "\n\n")
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), tagged.alias("tagged"))


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, raw): the lines of a text that are not blank, numbered from 1 among all lines."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "raw")).where(F.col("raw").rlike(r"\S")).select(key, (F.col("i") + 1).alias("line_no"), "raw")


def text_rows(docs: DataFrame, key: str, text: str, count: str | None = None) -> DataFrame:
    """(key, line_no, page, raw) of the lines with text, numbered from 0; page marks count pages and are no lines. count: one more column with this name, the number of a document's lines."""
    mark = r"(?i)^\[PAGE\s+(\d+)\]$"
    lines = F.filter(F.transform(F.split(F.col(text), r"[\r\n]+"), strip_white), lambda x: x != "")
    # A cast that fails costs an exception, so the lines without a mark are not cast. A document's page marks are few and go with each of its lines, so that no line has to be sorted after another.
    marks = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("at"), F.nullif(F.regexp_extract(x, mark, 1), F.lit("")).try_cast("int").alias("page"))), lambda m: m["page"].isNotNull())
    # A condition on what is made here would be put before the texts are dealt, and make the lines there once more.
    marked = settled(settled(docs.select(key, text), {"_lines": lines}), {"_marks": marks})
    each = marked.select(key, "_marks", F.size("_lines").alias("_size"), F.posexplode("_lines").alias("_at", "raw"))
    before = each.withColumn("_before", F.filter("_marks", lambda m: m["at"] <= F.col("_at")))
    last = F.try_element_at("_before", F.lit(-1))
    own = before.where(F.coalesce(last["at"] != F.col("_at"), F.lit(True)))
    more = [(F.col("_size") - F.size("_marks")).alias(count)] if count else []
    return own.select(key, (F.col("_at") - F.size("_before")).alias("line_no"), F.coalesce(last["page"], F.lit(1)).alias("page"), "raw", *more)


def content_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, first, n): equal contents once, with the first key."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n"))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """(key, chunk_id, chunk): windows of `size` characters that overlap; the last may lie inside the one before."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return df.where(F.char_length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk_id", "start")).select(key, "chunk_id", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def greedy_chunks(df: DataFrame, key: str, text: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """(key, chunk_id, chunk): lines packed into chunks of at most `size` characters; longer lines are cut into windows.

    A line joins the open chunk if both and the line break between fit; a line that reaches `size` closes the open chunk
    and gives its own windows, of which an empty buffer before it leaves no trace.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    step = size - overlap

    def add(acc: Column, line: Column) -> Column:
        joined = F.when(acc["open"] == "", line).otherwise(F.concat(acc["open"], F.lit("\n"), line))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        windows = F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(line) - 1, F.lit(0)), F.lit(step)), lambda s: F.substring(line, s + 1, F.lit(size)))
        made = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))
        return F.when(F.char_length(joined) <= size, made(acc["done"], joined)).when(F.char_length(line) <= size, made(closed, line)).otherwise(made(F.concat(closed, windows), F.lit("")))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    packed = F.aggregate(lines, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return df.select(key, F.posexplode(packed).alias("chunk_id", "chunk"))


#: Queries and vectors that are scored against each other in one group.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def _half_up(x: float) -> float:
    """Six decimals, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0 if math.isfinite(x) else x


def nearest(q: np.ndarray, v: np.ndarray, differ: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best vectors of each query where `differ`; equal rounded scores go by `order`.

    A matrix product finds the candidates; their scores are summed again part by part, so that blocks do not change them.
    """
    rough = np.where(differ, q @ v.T, -np.inf)
    rough[np.isnan(rough)] = np.inf
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    margin = 2e-6 + 1e-12 * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    rows, cols = np.nonzero(differ & (rough >= least[:, None] - (margin if np.isfinite(margin) else np.inf)))
    exact = np.zeros(len(rows))
    for j in range(q.shape[1]):
        exact += q[rows, j] * v[cols, j]
    values, at = np.unique(exact, return_inverse=True)
    score = np.array([_half_up(x) for x in values.tolist()], dtype=np.float64)[at]
    by = np.lexsort((order[cols], -np.where(np.isnan(score), np.inf, score), rows))
    rows, cols, score = rows[by], cols[by], score[by]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], cols[best], score[best]


def top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = DEFAULTS.top_k) -> DataFrame:
    """(query, key, score, rank): the k nearest vectors of each query by inner product, itself excluded; ties by key.

    Every query meets every vector of its length: a block of queries and a block of vectors are one group, which keeps k rows a
    query for the last ranking. A vector that is null or has null parts is no neighbour.
    """
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    parts = [max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK))]
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = lambda df, **blocks: df.where(whole).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("parts"), F.size(vector).alias("length"), *[c.alias(n) for n, c in blocks.items()])
    left, right = rows(queries, q_block=own(parts[0]), v_block=every(parts[1])), rows(vectors, q_block=every(parts[0]), v_block=own(parts[1]))
    kind = dict(vectors.dtypes)[key]

    def score(qs: pa.Table, vs: pa.Table) -> pa.Table:
        out = []
        if qs.num_rows and vs.num_rows:
            matrix = lambda t: t["parts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            q_ids, v_ids = qs["id"].to_pylist(), vs["id"].to_pylist()
            order = np.empty(len(v_ids), dtype=np.int64)
            order[sorted(range(len(v_ids)), key=v_ids.__getitem__)] = np.arange(len(v_ids))
            number = {x: i for i, x in enumerate(dict.fromkeys([*q_ids, *v_ids]))}
            differ = np.array([number[x] for x in q_ids])[:, None] != np.array([number[x] for x in v_ids])
            r, c, s = nearest(matrix(qs), matrix(vs), differ, order, k)
            out = [[q_ids[i] for i in r], [v_ids[i] for i in c], s]
        types = [qs.schema.field("id").type, vs.schema.field("id").type, pa.float64()]
        return pa.table({n: pa.array(x, type=t) for n, x, t in zip(("query", "id", "score"), out or [[], [], []], types, strict=True)})

    by = ["length", "q_block", "v_block"]
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, f"query {kind}, id {kind}, score double").withColumnRenamed("id", key)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_scope(ranked: DataFrame, threshold: float = DEFAULTS.similarity) -> DataFrame:
    """(query, best, in_scope): whether the best passage is near enough to answer from."""
    return ranked.groupBy("query").agg(F.max("score").alias("best")).withColumn("in_scope", F.col("best") >= threshold)
