"""The opN_ queries and the pipeline whole, on the smallest tables or small made ones, against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lines, quality, registry, rules, sharding, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def save(spark, tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# URL filters.


def brute_split(run: str, counts: dict, total: int) -> list[str]:
    score = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
    ways = [[run[i:j] for i, j in itertools.pairwise([0, *cut, len(run)])] for n in range(len(run)) for cut in itertools.combinations(range(1, len(run)), n)]
    return max(ways, key=lambda ws: sum(map(score, ws)))


def plain_verdicts(rows: list[tuple]) -> dict:
    """page_id to (verdict, score) by counting words of all pages, splitting all runs and scoring them, without Spark."""
    counts = Counter(w for _, _, html in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?s)<[^>]*>", " ", html or "").lower()))
    total = sum(counts.values()) + 1

    def words(run: str) -> list[str]:
        known = {(i, n): counts[run[i : i + n]] for i in range(len(run)) for n in range(1, len(run) - i + 1) if run[i : i + n] in counts}
        return urls.best_split(run, known, total)

    judged, seen = {}, []
    for page, url, _ in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split("[/?#]", rest)[0].translate({c: c + 32 for c in range(65, 91)})
        path = re.split("[?#]", rest[len(host) :])[0]
        hits = [(len(r), r, v) for v, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        tokens = []
        for mark, part in (("h", host), ("p", path)):
            for run in re.findall(r"[^\W\d_]+|[0-9]+", part.lower()):
                tokens += [mark + w for w in words(run)] if not run[0].isdigit() else [f"{mark}{run[0]}#{len(run)}"]
        judged[page] = (max(hits)[2] if hits else None, tokens)
        seen.append(judged[page])
    block, allow = (Counter(t for v, ts in seen if v == name for t in ts) for name in ("block", "allow"))
    kinds = len({t for _, ts in seen for t in ts})
    n_block, n_allow = (sum(v == name for v, _ in seen) for name in ("block", "allow"))
    odds = lambda t: math.log((block[t] + 1) / (sum(block.values()) + kinds)) - math.log((allow[t] + 1) / (sum(allow.values()) + kinds))
    out = {}
    for page, (verdict, tokens) in judged.items():
        score = math.log(n_block / n_allow) + sum(map(odds, tokens))
        out[page] = (verdict or ("block" if score > 0 else "allow"), score)
    return out


def test_op2_against_a_plain_classifier(spark, tmp_path):
    rng = random.Random(3)
    words = ["cheap", "pills", "news", "garden", "über", "w" + "x" * 40, "tea"]
    hosts = lambda: "".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30])))
    rows = [(i, f"http://{hosts()}.{rng.choice(['org', 'net', 'com', 'example.org'])}/{rng.choice(['fr', 'de', 'es', 'en', ''])}/{rng.randrange(200)}{hosts()}", f"<p>{' '.join(rng.choice(words) for _ in range(20))}</p>") for i in range(150)]
    rows += [(900, None, None), (901, "no scheme", "x y"), (902, f"http://{'cheappills' * 7}.net/", "")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in urls.op2_url_filter(spark, save(spark, tmp_path, pages=d)).collect()}
    want = plain_verdicts(rows)
    assert {p: r.verdict for p, r in got.items()} == {p: v for p, (v, _) in want.items()}
    assert all(got[p].score == pytest.approx(s, abs=1e-6) for p, (_, s) in want.items())
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_runs_of_any_length_are_split():
    counts, total = {"cheap": 50, "pills": 30, "x" * 30: 4, "ap": 9}, 1000
    known = lambda run: {(i, n): counts[run[i : i + n]] for i in range(len(run)) for n in range(1, min(len(run) - i, 40) + 1) if run[i : i + n] in counts}
    for run in ("cheappills" * 40, "cheap" + "x" * 30 + "pills" * 20):
        assert "".join(urls.best_split(run, known(run), total)) == run
    assert urls.best_split("cheappills" * 40, known("cheappills" * 40), total) == ["cheap", "pills"] * 40
    rng = random.Random(1)
    for _ in range(60):
        run = "".join(rng.choice(["cheap", "pills", "ap", "q", "zz"]) for _ in range(rng.randrange(1, 4)))[:11]
        score = lambda ws: sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in ws)
        assert score(urls.best_split(run, known(run), total)) == pytest.approx(score(brute_split(run, counts, total)))


# Every query once.


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.startswith("op")))
def test_every_query_has_its_columns_and_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.count()
    tables = {2: "pages", 11: "pages", 5: "conversations"}
    number = int(name[2:].split("_")[0])
    if number in (1, 3, 4, 6, 7, 9, 10, 12, 13, 2, 11):
        assert rows == spark.read.parquet(f"{SF}/{tables.get(number, 'documents')}.parquet").count()
    assert rows > 0


def test_op9_places_every_row(spark):
    got = sharding.op9_hilbert_shards(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and 0 <= r.shard < 40 and r.grown_shard is None
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_op7_counts(spark):
    got = {r.doc_id: r for r in rules.op7_line_field(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, r = d.text or "", got[d.doc_id]
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
        seen, dups = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)


# The pipeline.


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(["garden", "river", "stone", "cloud", "letter"]) + str(rng.randrange(9999)) for _ in range(12)) for _ in range(n))


def test_line_dedup_cuts_each_row_by_its_own_lines(spark):
    a, u1, u2 = "alpha beta gamma delta epsilon zeta", "unique line with many other words inside", "second unique thing that nobody else has said"
    rows = [(0, a), (1, f"{a}\nmore words that are only in this line"), (1, f"{u1}\n{u2}"), (None, a), (2, None), (3, ""), (4, a), (4, a)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, d, "").collect()), key=str)
    assert got == sorted([(0, a), (1, "more words that are only in this line"), (1, f"{u1}\n{u2}"), (None, a), (2, None), (3, "")], key=str)


def test_near_duplicates_keep_every_text_that_nothing_resembles(spark):
    t, u = prose(1, 6), prose(2, 6)
    near = t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, t), (2, t), (2, u), (3, near), (None, t), (None, "q w e r t y u"), (None, "q w e r t y u"), (7, ""), (7, None), (7, ""), (8, "one two"), (9, "one two")]
    d = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS).withColumn("group", F.lit("clash")).withColumn("text_hash", F.lit(5))
    out = corpus_pipeline.near_duplicates(spark, d, "")
    assert out.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, t), (2, u), (None, "q w e r t y u"), (7, ""), (7, None), (7, ""), (8, "one two")], key=str)


def test_stages_of_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates, corpus_pipeline.source_mix, corpus_pipeline.packing):
        assert stage(spark, d, "").count() == 0


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows
    fill: dict = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


# Ordinal quality.


def test_ordinal_gradient_matches_differences():
    rng = np.random.default_rng(4)
    scores, grades, weight, cuts = rng.normal(size=40), rng.integers(0, 3, 40), rng.random(40), np.array([-0.4, 0.9])
    plain = sum(w * math.log(p) for w, p in zip(weight, (np.diff([0, *(1 / (1 + np.exp(s - cuts))), 1])[g] for s, g in zip(scores, grades, strict=True)), strict=True))
    value, by_score, by_cut = quality.likelihood(scores, grades, cuts, weight)
    assert value == pytest.approx(plain)
    slope = lambda f, x, k: (f(x + 1e-6 * (np.arange(len(x)) == k)) - f(x - 1e-6 * (np.arange(len(x)) == k))) / 2e-6
    assert all(by_score[k] == pytest.approx(slope(lambda s: quality.likelihood(s, grades, cuts, weight)[0], scores, k), abs=1e-6) for k in range(40))
    assert all(by_cut[k] == pytest.approx(slope(lambda c: quality.likelihood(scores, grades, c, weight)[0], cuts, k), abs=1e-6) for k in range(2))


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(8)
    for n in range(1, 9):
        x = rng.integers(-3, 4, (n, len(rules.FEATURES))).astype(float)
        field = rules.LineField(rng.normal(size=(2, len(rules.FEATURES))), rng.normal(size=(2, 2)))
        scores = x @ field.emit.T
        value = lambda y, s=scores, f=field: sum(s[i, a] for i, a in enumerate(y)) + sum(f.move[a, b] for a, b in itertools.pairwise(y))
        assert value(field.viterbi(x)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))
    even = rules.LineField(np.zeros((2, len(rules.FEATURES))), np.zeros((2, 2)))
    assert (even.viterbi(np.zeros((4, len(rules.FEATURES)))) == rules.CONTENT).all()


def test_conflicting_labels_take_the_lowest(spark):
    labels = spark.createDataFrame([(i % 40, q, 0) for i, q in enumerate([0] * 40 + [1] * 40 + [1] * 20)] + [(i, 1, 0) for i in range(40, 80)], "doc_id bigint, quality bigint, toxic bigint")
    docs = spark.createDataFrame([(i, prose(i, 8) if i >= 40 else "#### $$$$\n|| ||\n" * 9, "en", "s", 1) for i in range(80)], DOCS)
    one, two = rules.fit_field(docs, labels), rules.fit_field(docs, labels.orderBy(F.rand()).repartition(3))
    assert (one.emit == two.emit).all() and (one.move == two.move).all()
    kept = {r.doc_id for r in rules.kept_documents(docs, one).collect()}
    assert kept and min(kept) >= 40


@pytest.mark.parametrize("kind", ["empty", "one grade"])
def test_grades_without_labels(spark, tmp_path, kind):
    docs = spark.createDataFrame([(1, "a text", "en", "s", 1), (2, None, "en", "s", 1), (2, "other", "en", "s", 1)] if kind == "one grade" else [], DOCS).withColumn("grade", F.lit("clash")).withColumn("ids", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id bigint, quality bigint, toxic bigint")
    got = quality.op4_ordinal_quality(spark, save(spark, tmp_path, documents=docs, labels=labels)).collect()
    assert len(got) == docs.count() and all(r.kept for r in got)
