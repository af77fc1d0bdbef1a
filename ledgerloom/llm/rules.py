"""Quality rules by line sequence labelling (operator 7).

A linear-chain conditional random field over the lines of a document marks each line as content or
boilerplate; the most likely labelling comes from the Viterbi recursion, and the share of a document's
words that lie in content lines decides whether it stays. Plain counting rules come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays when at least this share of its words lies in content lines.
MIN_CONTENT_SHARE = 0.5
#: The field is fitted on at most so many labelled documents: those with the lowest hash of their id.
FIT_DOCUMENTS = 4000
#: Of a longer one, so many lines in a row are seen by the fit, from a place that its id draws.
FIT_LINES = 200
FIT_ROUNDS = 60
CONTENT, BOILERPLATE = 1, 0
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MARKS = re.compile(rb"[^\x20\x09-\x0D\w]{2,}|[|{}<>=\\]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def triple_repeats(words: list[bytes]) -> tuple[int, np.ndarray]:
    """How many words lie in three-word windows that the text has twice or more, and the flags of those words."""
    n = len(words)
    covered = np.zeros(n, dtype=bool)
    if n >= 4:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * _A
        key = (h[:-2] * _A + h[1:-1]) * _B + h[2:]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[inverse] > 1)
        covered[again] = covered[again + 1] = covered[again + 2] = True
    return int(covered.sum()), covered


#: What is seen of a line, each as 0 or 1 (the first is always 1).
FEATURES = (
    "bias",
    "under 3 words",
    "3 to 7 words",
    "over 60 words",
    "half its letters are capitals",
    "a fifth of its characters are marks",
    "a mark run in every third word",
    "a fifth of its characters are digits",
    "ends like a sentence",
    "equal to an earlier line",
    "half its words repeat in windows",
    "under a third of its words differ",
    "under two thirds of its words differ",
    "long words",
    "bar between cells",
    "exclamation marks in every third word",
)


def line_features(line: bytes, words: list[bytes], seen: bool, covered: np.ndarray) -> list[int]:
    n, size = len(words), max(1, sum(map(len, words)))
    text = line.decode()
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    marks = len(_MARKS.findall(line))
    different = len(set(words)) / n
    last = words[-1][-1:]
    return [
        1, n < 3, 3 <= n < 8, n > 60, upper * 2 > letters > 0, (size_marks := len(text) - letters - digits - text.count(" ")) * 5 > len(text), marks * 3 > n,
        digits * 5 > len(text), last in b".?!", seen, covered.sum() * 2 > n, different < 1 / 3, different < 2 / 3, size > 14 * n, b"|" in line, text.count("!") * 3 > n and size_marks > 0,
    ]


def describe(text: str) -> tuple[dict, np.ndarray, np.ndarray]:
    """The counts of a text; features and word numbers of its lines that have words."""
    raw = text.encode()
    words = raw.split()
    repeats, covered = triple_repeats(words)
    seen: set[bytes] = set()
    rows, sizes, duplicates, at = [], [], 0, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            duplicates += again
            seen.add(line)
            rows.append(line_features(line, own, again, covered[at : at + len(own)]))
            sizes.append(len(own))
            at += len(own)
    counts = {
        "n_words": len(words), "word_chars": len(b"".join(words).decode()), "n_symbols": len(_SYMBOLS.findall(raw)),
        "n_dup_lines": duplicates, "n_repeat_words": repeats,
    }
    return counts, np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES)), np.array(sizes, dtype=np.int64)


class LineField:
    """A linear-chain conditional random field with two labels and the features above.

    `emit` has a row of weights for each label, `move[a, b]` the weight of label b after label a.
    """

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of the lines x; content wins ties."""
        scores = (x @ self.emit.T).tolist()
        # Lines come one after another, so plain numbers are quicker than arrays of two.
        (m00, m01), (m10, m11) = self.move.tolist()
        low, high = scores[0]
        back: list[tuple[int, int]] = []
        for s0, s1 in scores[1:]:
            from0, from1 = int(high + m10 >= low + m00), int(high + m11 >= low + m01)
            back.append((from0, from1))
            low, high = (high + m10 if from0 else low + m00) + s0, (high + m11 if from1 else low + m01) + s1
        labels = [1 if high >= low else 0]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return np.array(labels[::-1], dtype=np.int8)

    @classmethod
    def fit(cls, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = FIT_ROUNDS, penalty: float = 1e-3) -> LineField:
        """Maximum likelihood by gradient steps over all chains (features, labels) side by side, with a quadratic penalty."""
        k, width = len(FEATURES), max((len(y) for _, y in chains), default=1)
        x, y, live = np.zeros((len(chains), width, k)), np.zeros((len(chains), width), dtype=np.int64), np.zeros((len(chains), width), dtype=bool)
        for i, (a, b) in enumerate(chains):
            x[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
        emit, move = np.zeros((2, k)), np.zeros((2, 2))
        gold_emit = np.stack([(x * ((y == label) & live)[..., None]).sum((0, 1)) for label in (0, 1)])
        pairs = live[:, 1:]
        gold_move = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
        lines, sum_e, sum_m = max(1, live.sum()), np.full((2, k), 1e-8), np.full((2, 2), 1e-8)
        for _ in range(rounds):
            s = x @ emit.T
            ahead, behind = np.zeros((len(chains), width, 2)), np.zeros((len(chains), width, 2))
            ahead[:, 0] = s[:, 0]
            for t in range(1, width):
                step = np.logaddexp(ahead[:, t - 1, 0, None] + move[0], ahead[:, t - 1, 1, None] + move[1]) + s[:, t]
                ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
            for t in range(width - 2, -1, -1):
                follow = s[:, t + 1] + behind[:, t + 1]
                step = np.logaddexp(follow[:, 0, None] + move[:, 0], follow[:, 1, None] + move[:, 1])
                behind[:, t] = np.where(live[:, t + 1, None], step, 0)
            whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            p = np.exp(ahead + behind - whole[:, None, None]) * live[..., None]
            q = np.exp(ahead[:, :-1, :, None] + move + (s + behind)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[..., None, None]
            ge = (gold_emit - np.einsum("ntl,ntk->lk", p, x)) / lines - penalty * emit
            gm = (gold_move - q.sum((0, 1))) / lines - penalty * move
            sum_e, sum_m = sum_e + ge**2, sum_m + gm**2
            emit, move = emit + 0.5 * ge / np.sqrt(sum_e), move + 0.5 * gm / np.sqrt(sum_m)
        return cls(emit, move)


def fitted_lines(x: np.ndarray, doc_id: int) -> np.ndarray:
    """The rows of x that the fit sees: FIT_LINES in a row at most, so that their neighbours stay theirs, from anywhere in the document."""
    spare = max(0, len(x) - FIT_LINES)
    at = (int(doc_id) * 0x9E3779B97F4A7C15 >> 20) % (spare + 1)
    return x[at : at + FIT_LINES]


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = FIT_DOCUMENTS) -> LineField:
    """The field, fitted on the lines of at most `sample` labelled documents; every line takes its document's label.

    Chains are a good document followed by a bad one and the other way round, so that changes between the labels are seen.
    Only features of the sample come to the driver: of a document with more than FIT_LINES lines, a stretch of that many, see fitted_lines.
    Of several labels of a document the lowest holds. Without labels of both kinds every line is content.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = sample // 2
    chosen = known.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).union(known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(half))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "quality": batch.quality, "x": [fitted_lines(describe(t)[1], i).astype(np.int8).tobytes() for i, t in zip(batch.doc_id, batch.text, strict=True)]})

    sampled = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows of two numbers
    rows = sampled.mapInPandas(lines, "doc_id bigint, quality bigint, x binary").collect()
    known_x = [(r.doc_id, r.quality, np.frombuffer(r.x, dtype=np.int8).reshape(-1, len(FEATURES)).astype(float)) for r in rows if r.x]
    known_x.sort(key=lambda r: (r[0], r[2].tobytes()))
    good, bad = ([x for _, q, x in known_x if q == label] for label in (1, 0))
    if not good or not bad:
        emit = np.zeros((2, len(FEATURES)))
        emit[CONTENT, 0] = 1
        return LineField(emit, np.zeros((2, 2)))
    chains = []
    for i in range(max(len(good), len(bad))):
        a, b = (good[i % len(good)], CONTENT), (bad[i % len(bad)], BOILERPLATE)
        parts = [a, b] if i % 2 else [b, a]
        chains.append((np.concatenate([x for x, _ in parts]), np.concatenate([np.full(len(x), label) for x, label in parts])))
    chains.sort(key=lambda c: len(c[1]))
    return LineField.fit(chains)


VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_words bigint, content_share double, kept boolean"


def verdict(spark: SparkSession, field: LineField, min_share: float = MIN_CONTENT_SHARE):
    """A function of a text column: its counts, the words in content lines, their share, and whether the text is kept.

    Null or empty text: no words, so base_failed. Texts of any length are read whole.
    """
    held = spark.sparkContext.broadcast((field.emit, field.move))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = LineField(*held.value)
        for batch in batches:
            rows = []
            for text in batch:
                c, x, sizes = describe(text or "")
                failed = c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]
                content = int(sizes[crf.viterbi(x) == CONTENT].sum()) if len(x) else 0
                share = content / c["n_words"] if c["n_words"] else 0.0
                rows.append((*c.values(), failed, content, share, not failed and share >= min_share))
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in VERDICT.split(", ")])
        give_back()

    return F.pandas_udf(judge, VERDICT)


def judged(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id of every row of docs with its verdict; equal texts have equal verdicts, null doc_ids and columns of any names do not matter."""
    return docs.select("doc_id", verdict(docs.sparkSession, field)("text").alias("v")).select("doc_id", "v.*")


def kept_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns; each row is judged by its text alone, so null and empty texts go and equal rows stay or go together."""
    return docs.where(verdict(docs.sparkSession, field)("text")["kept"])


def op7_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and the verdict."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit_field(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_line_field": op7_line_field}
