"""The ten operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, fingerprints, groups, jaccard, mixing, packing, quality, rules, sharding, urls
from ledgerloom.llm.shingles import shingle_set, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, n string, id string, k string, row string"


def sentences(seed: int, n: int, words: int = 14) -> str:
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(words)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> dict:
    base = {i: sentences(i, 6) for i in range(12)}
    near = base[3].replace("w", "w", 1).rsplit(" ", 1)[0] + " changed."
    return base | {20: base[1], 21: base[1], 22: near, 23: "", 24: None, 25: "one two", 26: "One TWO", 27: " \n\t ", 28: sentences(99, 700), 29: "é" * 50 + "\nß ü"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["b", "a", None, "é"]
    rows = [(i, t, "en" if i % 3 else None, sources[i % 4] if i > 5 else "b", len(t) if t else None, "x", "x", "x", "x", "x") for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[2]], SCHEMA)  # one row twice


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left, total = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        out = {s: 3 * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mixing(spark, docs, nothing):
    got = mixing.mix_sources(docs.drop("size")).collect()
    assert len(got) == docs.count()
    sizes: dict = {}
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = expected_targets(sizes)
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= 2 and all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in got if r.source == s)
    again = mixing.mix_sources(docs.drop("size").repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(nothing.drop("size")).count() == 0


def test_mixed_documents_hold_the_words(spark, docs):
    counted = {}
    for r in mixing.mix_sources(docs.drop("size")).collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + r.taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out: dict = {}
    full = {r.doc_id: r.text for r in docs.collect()}
    for r in mixed.collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert full[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert out == {k: v for k, v in counted.items() if v}


def test_url_parts_and_rules(spark):
    rows = [
        (1, "http://A.Example.org/es/1?q#f", "<p>cheap pills cheap</p>"), (2, None, None), (3, "no scheme", ""), (4, "x://h.com/de/2", "<b>x</b>"), (5, "https://org", None), (6, "https://a.net?x=://y", None), (7, "http://cheappills.com/fr/9", "cheap"),
        (8, "http://example.org/en/12", None), (9, "http://example.org/en/2", None), (10, "http://notexample.org.net/es/1", None), (10, "http://notexample.org.net/es/1", None),
    ]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("score", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judged_urls(d).collect()}
    assert len(got) == 10
    want = {1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("", "", None, None), 3: ("", "", None, None), 4: ("h.com", "/de/2", "com/de/", "block"), 5: ("org", "", None, None), 6: ("a.net", "", None, None)}
    for k, (host, path, rule, verdict) in want.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and (verdict is None or got[k].verdict == verdict)
    assert got[8].rule == "example.org/en/1" and got[9].rule == "org/" and got[10].rule is None
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert urls.judged_urls(d.limit(0)).count() == 0


def test_best_split_is_the_most_probable():
    counts, total = {"cheap": 50, "pills": 30, "che": 5, "ap": 5, "a": 100}, 1000
    run = "cheappills"
    known = {(s, n): counts[run[s : s + n]] for s in range(len(run)) for n in range(1, len(run) - s + 1) if run[s : s + n] in counts}

    def score(words):
        return sum(np.log(counts[w] / total) if w in counts else np.log(10 / total) - len(w) * np.log(10) for w in words)

    ways = [[run[i:j] for i, j in itertools.pairwise([0, *cut, len(run)])] for n in range(len(run)) for cut in itertools.combinations(range(1, len(run)), n)]
    best = urls.best_split(run, known, total)
    assert best == ["cheap", "pills"] and score(best) == pytest.approx(max(map(score, ways)))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in groups.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def brute_groups(texts: dict, words: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_groups(spark, nothing):
    rng = random.Random(11)
    made: dict = {}
    for family in range(6):  # families of near copies around both sides of the threshold
        base = sentences(family, 5).split(" ")
        for member in range(7):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            made[family * 10 + member] = " ".join(w)
    made |= {100: "", 101: None, 102: "a b", 103: "A B", 104: "a b c", 105: made[0], 106: made[0].upper(), 107: " \n "}
    d = spark.createDataFrame([*made.items(), (105, made[105])], "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit("clash"))
    for words, percent in ((4, 85), (5, 80)):
        rows = jaccard.jaccard_groups(d, words, percent).collect()
        assert len(rows) == len(made) + 1
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(made, words, percent)
    assert jaccard.jaccard_groups(nothing).count() == 0


def near_sets(seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    pool = [rng.integers(0, 1 << 63, size=60).astype(np.uint64) for _ in range(40)]
    return [np.unique(np.concatenate([p[:50], rng.integers(0, 1 << 63, size=int(rng.integers(0, 12))).astype(np.uint64)])) for p in pool for _ in range(3)]


def tree_of(sets: list, ids: np.ndarray, groups: np.ndarray | None = None) -> jaccard.Tree:
    sizes, least = np.array([len(s) for s in sets]), np.array([s[0] for s in sets]).view(np.int64)
    return jaccard.Tree(ids, sizes, np.stack([jaccard.bitmap(s) for s in sets]), ids.copy() if groups is None else groups, least)


def reaching(sets: list) -> set:
    return {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 185 * len(np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]))}


def test_tree_traversal_loses_no_pair():
    sets = near_sets(2)
    ids, true = np.arange(len(sets)), reaching(sets)
    tree = tree_of(sets, ids)
    assert len(tree.levels) == 4 and len(tree.levels[-1].low) == 1
    found = jaccard.tree_pairs(tree, tree, 85)
    assert true and true <= set(found) and len(found) == len(set(found)) < 3 * len(true)
    # Two trees, one deeper than the other.
    a, b = tree_of(sets[:7], ids[:7]), tree_of(sets[7:], ids[7:])
    assert {p for p in true if p[0] < 7 <= p[1]} <= set(jaccard.tree_pairs(a, b, 85))
    # Rows of one group are not paired.
    groups = ids // 3
    assert all(groups[p] != groups[q] for p, q in jaccard.tree_pairs(*[tree_of(sets, ids, groups)] * 2, 85))


def test_spanning_pairs_tie_what_all_pairs_tie():
    sets = near_sets(5)
    tree = tree_of(sets, np.arange(len(sets)))
    every, few = jaccard.tree_pairs(tree, tree, 85), jaccard.tree_pairs(tree, tree, 85, True)

    def parts(pairs):
        part = list(range(len(sets)))
        for a, b in pairs:
            x, y = part[a], part[b]
            part = [min(x, y) if p in (x, y) else p for p in part]
        return part

    assert set(few) <= set(every) and parts(few) == parts(every) and len(few) == len(sets) - len(set(parts(every)))


def test_size_classes(spark):
    sizes = spark.range(1, 3000).toDF("n")
    for percent in (50, 80, 85, 99):
        of = {r.n: r.c for r in sizes.withColumn("c", jaccard.size_class("n", percent)).collect()}
        for n in of:
            most = n * 100 // percent
            assert most > 2999 or of[most] - of[n] in (0, 1)


def test_keys_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = sentences(3, 12).split(" ")
    rng = random.Random(8)
    made = {}
    for i in range(90):  # one large group of near copies and strays that share its passages
        w = base[: len(base) if i % 5 else 100]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        made[i] = " ".join(w)
    d = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(d).collect()} == brute_groups(made, 4, 85)


def test_shingles_of_short_texts():
    assert len(shingle_set(None, 4)) == 0 and len(shingle_set(" \n", 4)) == 0 and len(shingle_set("a b", 4)) == 1 and len(shingle_set("a b c d e", 4)) == 2
    assert (shingle_set("A b", 4) == shingle_set("a B", 4)).all() and shingle_set("a b", 4)[0] != shingle_set("b a", 4)[0]


def test_shingles_of_many_texts_equal_those_of_each():
    texts = ["", None, "a b c d e é ß", "x" * 3_000_000, "A\tB\x0bC\x0cD\r\nE", "\x1c\x85 q\u2003r s t u", *[sentences(i, 3) for i in range(5)]]
    together = list(shingle_sets(texts, 3))
    for t, s in zip(texts, together, strict=True):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert len(s) == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else ()) and (s == shingle_set(t, 3)).all()


def test_ordinal_regression_separates_grades(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(300)}"
    good = [" ".join(word() for _ in range(60)) for _ in range(120)]
    bad = [" ".join(word() + "%%%" for _ in range(60)) for _ in range(120)]
    rude = [" ".join([*(word() for _ in range(55)), "nasty", "vile"]) for _ in range(120)]
    f = quality.WordFeatures()
    ids = [quality.features(t, f) for t in [*rude, *bad, *good]]
    grades = np.repeat([0, 1, 2], 120)
    train = np.arange(360) % 2 == 0
    model = quality.OrdinalModel.fit([x for x, t in zip(ids, train, strict=True) if t], grades[train])
    tails = model.tails([x for x, t in zip(ids, train, strict=True) if not t])
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 1] >= 0.5) == (grades[~train] == 2)).mean() > 0.97
    d = spark.createDataFrame([(1, good[0]), (2, None), (3, ""), (4, rude[0])], "doc_id bigint, text string")
    assert d.select("doc_id", quality.rating(spark, model)("text").alias("r")).select("doc_id", "r.*").where("kept is null").count() == 0


def test_ordinal_fit_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit_model(docs, none)
    assert docs.select(quality.rating(spark, model)("text")["kept"].alias("k")).where("not k").count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "second ### x \\### </turn> \\\\ é😀"), (1, 0, "user", None), (2, 0, None, "### System: </turn>\n"), (2, None, "assistant", "a"), (2, None, "assistant", "a"), (None, 0, "assistant", "null conv"), (3, 5, "assistant", ""),
    ]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(d)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for text in ("", "\\", "###", "\\###", "</turn>", "\\\\</turn>", "a\\b"):
        assert chat.unescape(chat.escape(text)) == text
    assert chat.conversation_digests(chat.formatted_turns(d.limit(0))).count() == 0


def test_fingerprints(spark, docs, texts, nothing):
    pieces = re.compile(fingerprints.PARAGRAPH)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: r[0])
    got = fingerprints.fingerprinted(docs).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine = [g for g in got if g.doc_id == doc_id]
        a, e, n = (set(pieces.findall(t)) for t in (text, edited, after))
        assert any(g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and abs(g.near_edited - like(a, e)) < 1e-9 and abs(g.near_next - like(a, n)) < 1e-9 for g in mine)
    prints = {g.doc_id: g.fingerprint for g in got}
    assert prints[1] == prints[20] == prints[21] and prints[1] != prints[2]
    assert fingerprints.fingerprinted(nothing).count() == 0
    one = fingerprints.fingerprinted(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_peeling_grows_until_it_succeeds(spark):
    rows = [(0, "edited", list(range(100)), list(range(95, 400))), (1, "edited", [1, 2], [2, 1]), (2, "next", list(range(2000)), list(range(1, 2000)))]
    d = spark.createDataFrame(rows, "uid bigint, kind string, x array<bigint>, y array<bigint>")
    assert {r.uid: r.differing for r in fingerprints.differences(d).collect()} == {0: 395, 2: 1}
    found = {(r.uid, r.digest, r.side) for r in fingerprints.differing_digests(d).collect()}
    assert found == {(0, i, 1) for i in range(95)} | {(0, i, -1) for i in range(100, 400)} | {(2, 0, 1)}


def test_rules_counts(spark, docs, texts):
    field = rules.LineField(np.array([[0.0] * len(rules.FEATURES), [1.0] + [0.0] * (len(rules.FEATURES) - 1)]), np.zeros((2, 2)))
    got = {r.doc_id: r for r in rules.judged(docs, field).collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + o for j, x in enumerate(windows) if windows.count(x) > 1 for o in range(3)} if len(w) < 200 else None
        g = got[i]
        assert (g.n_words, g.word_chars) == (len(w), sum(map(len, w))) and g.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert covered is None or g.n_repeat_words == len(covered)
        assert g.base_failed == (len(w) < 50 or 100 * g.n_repeat_words > 50 * len(w)) and not (g.base_failed and g.kept)


def test_viterbi_and_fit():
    rng = np.random.default_rng(0)
    k = len(rules.FEATURES)
    field = rules.LineField(rng.normal(size=(2, k)), rng.normal(size=(2, 2)))
    x = (rng.random((7, k)) > 0.5).astype(float)

    def score(labels):
        return sum(field.emit[y] @ x[i] for i, y in enumerate(labels)) + sum(field.move[a, b] for a, b in itertools.pairwise(labels))

    assert score(field.viterbi(x)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=7))))
    chains = []
    for _ in range(60):
        y = (rng.random(5) > 0.5).astype(int)
        f = np.zeros((5, k))
        f[:, 0], f[:, 5] = 1, 1 - y
        chains.append((f, y))
    learned = rules.LineField.fit(chains)
    assert all((learned.viterbi(f) == y).all() for f, y in chains)


def test_packing(spark, docs, texts, nothing):
    out = packing.packed_documents(docs, max_tokens=64).collect()
    tokenizer = packing._tokenizer(packing.tokenizer_file())
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        copies = 2 if i == 2 else 1
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        assert sum(r.length for r in mine) == copies * len(ids)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed_documents(nothing).count() == 0


def test_histogram_packing_uses_every_length_once():
    rng = random.Random(4)
    for _ in range(100):
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        patterns = packing.shortest_pack_first(histogram, 64)
        assert all(sum(n * t for n, t in slots) <= 64 for _, slots in patterns)
        used: dict = {}
        for count, slots in patterns:
            for n, t in slots:
                used[n] = used.get(n, 0) + count * t
        assert used == histogram


def test_word_ids_equal_the_tokenizer():
    rng = random.Random(6)
    ids = packing.WordIds(packing.tokenizer_file())
    signs = "aZ'é ÜßĀſŁ09!<|>%.,ñÇŸİıſŉΣσ×µ́\x1c\x85\xa0~`"
    for _ in range(2000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 12)))
        assert ids.of(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 2)):
        places, states = sharding.curve_tables(dims)

        def at(x):
            state = h = 0
            for b in range(bits - 1, -1, -1):
                e = state * (1 << dims) + sum(((v >> b) & 1) << a for a, v in enumerate(x))
                h, state = h * (1 << dims) + places[e], states[e]
            return h

        points = sorted(itertools.product(range(1 << bits), repeat=dims), key=at)
        assert [at(p) for p in points] == list(range(len(points)))
        assert all(sum(abs(u - v) for u, v in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(points))


def test_shards(spark, docs, nothing):
    base = docs.select("doc_id", "source", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    got = sharding.shard_by_curve(base, ["source", "lang", "size"], ["doc_id"], 7).collect()
    counts = [sum(r.shard == s for r in got) for s in range(7)]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert [r.curve for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.curve for r in got)
    empty = nothing.select("doc_id", "source", "lang", F.lit(1).alias("size"))
    assert sharding.shard_by_curve(empty, ["source", "lang", "size"], ["doc_id"], 7).count() == 0


def test_fitted_lines_come_from_the_whole_document():
    x = np.arange(1000).reshape(-1, 1)
    drawn = [rules.fitted_lines(x, i)[:, 0] for i in range(-50, 400)]
    assert all(len(d) == rules.FIT_LINES and (np.diff(d) == 1).all() for d in drawn)
    assert min(d[0] for d in drawn) < 50 and max(d[-1] for d in drawn) > 950
    assert len(rules.fitted_lines(x[:200], 7)) == 200 and len(rules.fitted_lines(x[:0], 7)) == 0
