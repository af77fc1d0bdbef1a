"""Quality classifier by ordinal cumulative-link regression (operator 4).

Graded ratings 0 < 1 < ... < K share one vector of weights over hashed text features; ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). The expected grade and the probability of
the top grade select documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

BITS = 18
#: The model is fitted on at most so many labelled documents of each grade: those with the lowest hash of their id.
FIT_PER_GRADE = 4000
GRADES = 3
EPOCHS = 30
#: A feature takes part when its likelihood ratio against the grades in the sample reaches this; chance alone rarely gets there.
MIN_RATIO = 20.0
#: Kept when the probability of the top grade reaches this.
MIN_TAIL = 0.5
CACHE_WORDS = 400_000
_CORE = re.compile(rb"[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")


def _bucket(token: bytes) -> int:
    return zlib.crc32(token) >> (32 - BITS)


class WordFeatures(dict):
    """The hashed features of a word: its letters in lower case, and the marks around them."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        cores = _CORE.findall(word)
        marks = _CORE.sub(b"", word)
        out = [_bucket(b"w " + c.decode().lower().encode()) for c in cores]
        if marks:
            out.append(_bucket(b"m " + marks))
        self[word] = out = tuple(out)
        return out


def features(text: str, words_of: WordFeatures) -> np.ndarray:
    """The distinct hashed features of a whole text: its words, and the rough shape of it all."""
    if len(words_of) > CACHE_WORDS:
        words_of.clear()
    raw = text.encode()
    words = raw.split()
    n, different = max(1, len(words)), set(words)
    tenths = lambda part, whole: min(10, 10 * part // max(1, whole))
    letters = sum(map(len, words)) or 1
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    signs = len(raw) - len(raw.translate(None, b"#*$%&|<>!"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    shape = {
        "size": n.bit_length(), "different": tenths(len(different), n), "capitals": tenths(capitals, letters), "signs": tenths(5 * signs, letters),
        "digits": tenths(digits, letters), "lines": tenths(len(set(lines)), len(lines)), "length": min(20, letters // n),
    }
    out = {i for word in different for i in words_of[word]}
    out.update(_bucket(f"s {k} {v}".encode()) for k, v in shape.items())
    return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def likelihood_ratios(ids: list[np.ndarray], grades: np.ndarray, grade_count: int) -> np.ndarray:
    """For each feature, twice the log likelihood that its presence depends on the grade over that it does not."""
    size = np.bincount(grades, minlength=grade_count).astype(float)
    have = np.stack([np.bincount(np.concatenate([i for i, y in zip(ids, grades, strict=True) if y == g] or [np.zeros(0, np.int32)]), minlength=1 << BITS) for g in range(grade_count)]).astype(float)
    share = have.sum(axis=0) / size.sum()
    out = np.zeros(1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for g in range(grade_count):
            for seen, expected in ((have[g], size[g] * share), (size[g] - have[g], size[g] * (1 - share))):
                out += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0)
    return out


def likelihood(scores: np.ndarray, grades: np.ndarray, thresholds: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted log likelihood of grades under ordered thresholds, and its slopes by each score and by each threshold."""
    cuts = np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper, lower = cuts[grades + 1] - scores, cuts[grades] - scores
    fu, fl = _sigmoid(upper), _sigmoid(lower)
    p = np.maximum(fu - fl, 1e-9)
    du, dl = np.where(np.isinf(upper), 0, fu * (1 - fu)) / p, np.where(np.isinf(lower), 0, fl * (1 - fl)) / p
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, grades + 1, du * weight)
    np.add.at(by_cut, grades, -dl * weight)
    return float((weight * np.log(p)).sum()), (dl - du) * weight, by_cut[1:-1]


class OrdinalModel:
    """weights over 2^BITS features and GRADES - 1 ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, ids: list[np.ndarray]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each text."""
        scores = np.array([self.weights[i].sum() for i in ids])
        return _sigmoid(scores[:, None] - self.thresholds)

    @classmethod
    def fit(cls, ids: list[np.ndarray], grades: np.ndarray, grade_count: int = GRADES, epochs: int = EPOCHS, penalty: float = 1e-4, evening: float = 0.5) -> OrdinalModel:
        """Maximum likelihood by adaptive gradient steps over small batches; rare grades weigh more, by the power `evening` of their rarity.

        Features that tell the grades apart no better than chance get no weight. Thresholds stay
        ordered: the first is free, each next one lies an exponential above it.
        """
        useful = likelihood_ratios(ids, grades, grade_count) >= MIN_RATIO
        ids = [i[useful[i]] for i in ids]
        rng = np.random.default_rng(5)
        weights, step = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
        first, gaps = -1.0, np.zeros(grade_count - 2)
        first_step, gap_step = 1e-6, np.full(grade_count - 2, 1e-6)
        share = np.bincount(grades, minlength=grade_count)
        balance = np.where(share > 0, (len(grades) / np.maximum(share, 1) / max(1, (share > 0).sum())) ** evening, 0)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // 128)):
                flat = np.concatenate([ids[i] for i in batch])
                sizes = np.array([len(ids[i]) for i in batch])
                owner = np.repeat(np.arange(len(batch)), sizes)
                score = np.bincount(owner, weights[flat], minlength=len(batch))
                y = grades[batch]
                _, g_score, inner = likelihood(score, y, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), balance[y] / len(batch))
                g = np.bincount(flat, g_score[owner], minlength=1 << BITS) - penalty * weights
                step += g * g
                weights += 0.3 * g / np.sqrt(step)
                first_step += inner.sum() ** 2
                first += 0.1 * inner.sum() / np.sqrt(first_step)
                if len(gaps):
                    g_gap = np.cumsum(inner[::-1])[::-1][1:] * np.exp(gaps)
                    gap_step += g_gap**2
                    gaps += 0.1 * g_gap / np.sqrt(gap_step)
        return cls(weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): toxic 0, else of low quality 1, else 2; rows without both labels are left out, the lowest grade of a document holds."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rows = labels.where(F.col("toxic").isNotNull() & F.col("quality").isNotNull()).select("doc_id", grade.alias("grade"))
    return rows.where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_model(docs: DataFrame, labels: DataFrame, per_grade: int = FIT_PER_GRADE) -> OrdinalModel:
    """The model, fitted on at most per_grade labelled documents of each grade; their hashed features come to the driver.

    Rows that share a labelled doc_id all count, each with its own text; null texts and rows without doc_id do not. Other columns of docs and labels
    are not read. Empty tables, and labels of one grade, give a model that puts every text into the top grade.
    """
    known = graded(labels)
    samples = [known.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade) for g in range(GRADES)]
    chosen = samples[0].union(samples[1]).union(samples[2])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = WordFeatures()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "grade": batch.grade, "ids": [features(t, words_of).tobytes() for t in batch.text]})

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(hashed, "doc_id bigint, grade int, ids binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.ids))
    if len({r.grade for r in rows}) < 2:
        return OrdinalModel(np.zeros(1 << BITS), np.full(GRADES - 1, -35.0))
    return OrdinalModel.fit([np.frombuffer(r.ids, dtype=np.int32) for r in rows], np.array([r.grade for r in rows]))


def rating(spark: SparkSession, model: OrdinalModel, min_tail: float = MIN_TAIL):
    """A function of a text column: expected grade, probability of the top grade, and whether that reaches min_tail.

    Null text: as an empty one. With labels of fewer than two grades to fit on, every text gets the top grade.
    """
    held = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2^BITS numbers

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, words_of = OrdinalModel(*held.value), WordFeatures()
        for batch in batches:
            tails = own.tails([features(t or "", words_of) for t in batch]) if len(batch) else np.zeros((0, GRADES - 1))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1).round(6), "tail_probability": tails[:, -1].round(6), "kept": tails[:, -1] >= min_tail})

    return F.pandas_udf(rate, "expected_grade double, tail_probability double, kept boolean")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with expected grade, probability of the top grade and the choice."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", rating(spark, model)("text").alias("r")).select("doc_id", "r.*")


QUERIES = {"op4_ordinal_quality": op4_ordinal_quality}
