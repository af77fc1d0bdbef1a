"""Line dedup against brute force: links, groups, recall over kinds of edits, crowded keys."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import groups, lines

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(spark, nothing):
    long = "the quick brown fox jumps over the lazy dog near the old river bank every single morning while the birds sing their songs above the tall green trees of the valley"
    close = long.replace("lazy", "lazy,").upper()
    rows = [(1, f"{long}\nshort line\n\n{long}"), (2, f"x\n{close}\nshort line"), (3, None), (4, ""), (5, "other words entirely here in this line\n" + long), (5, "other words entirely here in this line\n" + long), (None, long)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit("clash")).withColumn("h", F.lit(1))
    got = {(r.doc_id, r.removed_lines): r.text for r in lines.without_repeats(d).collect()}
    assert got[1, 1] == f"{long}\nshort line\n" and got[2, 1] == "x\nshort line" and got[3, 0] is None and got[4, 0] == ""
    assert got[5, 1] == "other words entirely here in this line" and got[None, 0] == long
    assert lines.without_repeats(nothing).count() == 0
    assert lines.deduplicated_documents(d.withColumn("n_chars", F.lit(0))).columns == [*d.columns, "n_chars"]


def _edited_lines() -> list[tuple[str, str]]:
    """Lines of 8 to 30 words and a version of each with one word of ten replaced, so that brute force has it above 0.8 in nearly all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    pairs = []
    for i in range(300):
        words = [word() for _ in range(8 + i % 23)]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 10)):
            other[at] = word()
        pairs.append((" ".join(words), " ".join(other)))
    return pairs


def test_line_dedup_recall_against_brute_force(spark):
    pairs = _edited_lines()
    texts = [t for p in pairs for t in p]
    alike = lambda x, y: lines.within_edits(x, y, max(len(x), len(y)) * (100 - lines.MIN_PERCENT) // 100)
    want = {(i, j) for i in range(len(texts)) for j in range(i) if min(map(len, (texts[i], texts[j]))) * 10 >= 8 * max(map(len, (texts[i], texts[j]))) and alike(texts[j], texts[i])}
    assert len(want) > 250
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    gone = {r.doc_id for r in lines.without_repeats(d).where("removed_lines > 0").collect()}
    assert gone <= {i for i, _ in want}
    assert len(gone) >= 0.95 * len({i for i, _ in want})




def plain_distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_edits_against_a_plain_distance():
    rng = random.Random(1)
    for _ in range(1500):
        x = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 25)))
        y = "".join(rng.choice(["", "a", "b ", " ", c + "c"]) if rng.random() < 0.2 else c for c in x)
        d = plain_distance(x, y)
        assert lines.edits_at_most(x, y) >= d
        assert all(lines.within_edits(x, y, n) == (d <= n) for n in (d - 1, d, d + 1) if n >= 0)


def test_edits_of_long_lines_are_given_up_early():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for n in range(24):
        x, shift = text(300), 10 * (n % 12)
        y = text(shift) + x[: 300 - shift] if n < 12 else "".join(rng.choice("abcd") if rng.random() < 0.03 * (n - 12) else c for c in x)
        d = plain_distance(x, y)
        assert all(lines.within_edits(x, y, limit) == (d <= limit) for limit in (d - 1, d, d + 1, 60))


def test_marks_tell_lines_that_share_few_words(spark):
    """The marks of lines let all pairs through that share words enough, and few others."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = [" ".join([word() for _ in range(n)]) for n in range(5, 60) for _ in range(2)]
    for t in list(texts):
        words = t.split(" ")
        for at in rng.sample(range(len(words)), len(words) // 2):
            words[at] = word()
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in lines.line_rows(d).collect()}
    met = [(i, j) for i in rows for j in rows if i < j]
    names = ["n_words", *[f"mark_{i}" for i in range(lines.MARKS)]]
    pairs = spark.createDataFrame([(i, j, *[rows[k][c] for k in (i, j) for c in names]) for i, j in met], ", ".join(["i int", "j int", *[f"{s}_{c} bigint" for s in "xy" for c in names]]))
    side = lambda s: {c: F.col(f"{s}_{c}") for c in names}
    kept = {(r.i, r.j) for r in pairs.where(lines.may_share(side("x"), side("y"))).collect()}
    share = lambda a, b: 100 * len(a & b) >= lines.SHARED_PERCENT * max(len(a), len(b))
    want = {(i, j) for i, j in met if share(set(texts[i].split(" ")), set(texts[j].split(" ")))}
    assert len(want) > 50 and want <= kept and len(kept) < len(met) / 20


def test_second_round_joins_groups_of_the_first(spark):
    """Groups of the first round, and rows that had none, are joined by the second; groups that it does not touch stay."""
    # Key 1: hub 0 is linked to 2; 4 and 6 find each other in the second round; 8 joins 2's group through 3, which is in it by key 2.
    postings = spark.createDataFrame([(1, i) for i in (0, 2, 4, 6, 8)] + [(2, 0), (2, 3), (3, 20), (3, 21)], "k bigint, id bigint").selectExpr("k", "id", "0 as n")
    true = [(0, 2), (0, 3), (4, 6), (2, 8), (20, 21)]
    asked = []

    def links(pairs):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.where(" or ".join(f"(a = {a} and b = {b})" for a, b in true))

    own = spark.createDataFrame([(i, i % 2) for i in (0, 2, 3, 4, 6, 8, 20, 21)], "id bigint, parity int")
    got = {r.id: r.component for r in groups.grouped(postings, ["n"], lambda x, y: x["n"] == y["n"], links, closer=(own, lambda x, y: x["parity"] == y["parity"])).collect()}
    assert got == {0: 0, 2: 0, 3: 0, 8: 0, 4: 4, 6: 4, 20: 20, 21: 20} and len(asked) == 2


def test_simhashes_count_bits():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 2, 5, 255, 256, 700])
    h = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    at = 0
    for n, got in zip(sizes.tolist(), lines.simhashes(h, sizes).view(np.uint64), strict=True):
        bits = np.unpackbits(h[at : at + n].view(np.uint8)).reshape(n, 64).sum(axis=0)
        assert (np.unpackbits(np.array([got]).view(np.uint8)) == (2 * bits > n)).all()
        at += n


def test_few_replaced_words_leave_a_block():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(5000)]
    for n in (50, 120, 400):
        for _ in range(40):
            one = rng.sample(words, n)
            other = list(one)
            for at in rng.sample(range(n), 2):
                other[at] = rng.choice(words)
            found = lines.Lines(" ".join(one).encode() + b"\n" + " ".join(other).encode())
            line, h = lines.distinct_words(found.h, found.line)
            of, keys = lines.block_keys(line, h, np.bincount(line))
            assert set(keys[of == 0]) & set(keys[of == 1])


def test_lines_of_a_text():
    text = "Ab,c  9!\n\n é x\r\ny z"
    found = lines.Lines(lines.translated(text))
    assert [found.form(i) for i in range(4)] == ["ab c 0", "", "é x", "y z"] and found.size.tolist() == [6, 0, 3, 3] and found.n_words.tolist() == [3, 0, 2, 2]
    assert len(set(found.hash.tolist())) == 4 and lines.Lines(b"ab c 0").hash[0] == found.hash[0]


def test_crowded_keys_keep_links_of_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "CROWD", 3)
    rows = [(k, i) for i in range(40) for k in (1, 100 + i // 2, 200 + i // 2)]  # one key that all have; pairs share two more
    postings = spark.createDataFrame(rows, "k bigint, id bigint").selectExpr("k", "id", "0 as n")
    keys = postings.groupBy("id").agg(F.collect_list("k").alias("keys"))
    asked = []

    def links(pairs):
        asked.append(pairs.count())
        return pairs.where("a div 2 = b div 2")

    got = {r.id: r.component for r in groups.grouped(postings, ["n"], lambda x, y: x["n"] == y["n"], links, keys).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)} and max(asked) < 100


def test_crowded_keys_keep_links_of_one_block(spark, monkeypatch):
    """A crowded key gives the links of rows that share no other key, inside and outside its largest group, and no pair twice."""
    monkeypatch.setattr(groups, "CROWD", 3)
    # 40 rows of one key in 20 groups of 2, and one large group; numbers agree across groups in twos.
    rows = [(7, i, i // 2 if i < 40 else 99, i % 20) for i in range(60)]
    postings = spark.createDataFrame(rows, "k bigint, id bigint, component bigint, n int")
    got = [(r.a, r.b) for r in groups.cross_pairs(groups._open(postings), ["n"], lambda x, y: x["n"] == y["n"]).collect()]
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] != b[2] and a[3] == b[3])
    assert sorted(got) == want


def test_crowded_keys_are_not_narrowed(spark, monkeypatch):
    """Rows 10 and 11 share key 7 alone, which is crowded; they are linked nevertheless."""
    monkeypatch.setattr(groups, "CROWD", 3)
    postings = spark.createDataFrame([(7, i, 100 + i if i not in (10, 11) else 5) for i in range(30)], "k bigint, id bigint, n int")
    got = {r.id: r.component for r in groups.grouped(postings, ["n"], lambda x, y: x["n"] == y["n"], lambda pairs: pairs).collect()}
    assert got.get(10) == got.get(11) == 10
