"""Readings of statements and payslips: what is read once, and that the shorter ways give what the plain ones would."""

from __future__ import annotations

from itertools import permutations

from tests.test_growth import planned


def test_extra_income_reads_each_evidence_once(spark):
    """No reading stands twice in the plan: neither to judge its words nor for what else shows that operations were read."""
    plan = planned(spark, "extra_income")
    assert plan.count("Relation") <= 11 and plan.count("Join ") <= 5


def test_words_are_compared_in_their_rows(spark):
    from ledgerloom.operators import statements as ops

    targets = dict(ops.MISREAD) | ops.DIRECTIONS
    rows = [["virement", "recu", "x"], [], None, ["emis", "emiz", "ABEGIL", "é"], ["".join(p) for p in permutations("recu")], [t + "s" for t in targets]]
    made = ops.near_words(ops.F.col("words"), targets)
    got = [[tuple(x) for x in r.near] for r in spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, words array<string>").coalesce(1).sortWithinPartitions("i").select(made.alias("near")).collect()]
    assert got == [[(t, len(w), ops.likeness(w, t)) for w in ws or [] for t, least in targets.items() if ops.likeness(w, t) >= least] for ws in rows]


def test_equal_misread_lines_count_once_by_the_first(spark):
    from ledgerloom.operators import statements as ops

    line = "01/02/2020 VIREMENT RECU DE X 10,00"
    lines = spark.createDataFrame([(1, 2, 9, line), (1, 1, 4, line), (1, 1, 7, line), (1, 1, 5, "02/02/2020 RETRAIT 5,00"), (2, 1, 1, line)], "k int, page int, line_no int, raw string").repartition(4)
    docs = spark.createDataFrame([(1, "01/02/2020"), (2, "x")], "k int, text string")
    got = ops.fuzzy_lines(lines, docs, "k", "text", "raw", ("page", "line_no")).collect()
    assert sorted((r.k, r.page, r.line_no, str(r.date), r.amount) for r in got) == [(1, 1, 4, "2020-02-01", 10.0), (2, 1, 1, "2020-02-01", 10.0)]


def test_income_evidence_reads_each_evidence_once(spark):
    plan = planned(spark, "income_evidence")
    assert plan.count("Relation") <= 10 and plan.count("Join ") <= 5 and "aggregate(items" not in plan


def test_merged_evidence_is_what_comparing_all_gives(spark):
    """Against the rule as it is worded, on NULL, NaN, signed zeros, empty quotes and descriptions, and keys of several columns."""
    from itertools import product

    from ledgerloom.operators.statements import MERGED, merge_evidence

    nan = float("nan")
    some = list(product((1, None), ("2020-01-01", None, " "), (10.0, 10.001, 0.0, -0.0, nan, None), ("virement x", "VIREMENT  X", "x", "", None), ("a  b", "A b ", "", None)))
    rows = [(i % 7, "ab"[i // 7 % 2], i % 3, i, *some[i * 131 % len(some)]) for i in range(700)]

    def plain(x):
        return " ".join((x or "").lower().split())

    def cents(x):
        return "nan" if x is not None and x != x else x if x is None else round(x, 2) + 0.0

    want = []
    for group in sorted({r[:2] for r in rows}):
        kept = []
        for r in sorted((r for r in rows if r[:2] == group), key=lambda r: (r[2], r[3])):
            quote, cell, words = plain(r[8]), (r[4], plain(r[5]), cents(r[6])), plain(r[7])
            if not any((quote and quote == q) or (cell == c and (words in w or w in words)) for q, c, w in kept):
                kept.append((quote, cell, words))
                want.append((*group, r[3]))
    df = spark.createDataFrame(rows, "k int, part string, priority int, pos int, page int, date string, amount double, description string, quote string")
    got = merge_evidence(df, ["k", "part"])
    assert got.columns == ["k", "part", *MERGED]
    assert sorted((r.k, r.part, r.pos) for r in got.collect()) == sorted(want) and len(want) < len(rows)


def test_payslips_are_dealt_once_before_anything_is_read(spark):
    """Into parts that stay as many as they are; the lines are not made before, nor once more for a condition on them."""
    import re

    plan = planned(spark, "payslip_extraction")
    assert re.findall(r"RepartitionByExpression \[o_orderkey#\d+L\], (\d+)", plan) == ["8"] * 3
    assert all("split(" not in part.split("Relation")[0] for part in plan.split("RepartitionByExpression")[1:])


def test_labels_are_found_as_by_their_pattern(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.text import ACCENTED, PLAIN
    from ledgerloom.operators import payslips as ops

    texts = ["Période de paie | NET À PAYER", "Date d'embauche :", "net a  payer", "NET-A-PAYER", "netapaye", "Emploi occupé", "ʼposte", "Kſİ", "", " | ", None, "Société Ñ ÿ", "n° CIN", "cinema"]
    groups = {**ops.LABELS, "others": ops.OTHER_LABELS}
    old = F.trim(F.regexp_replace(F.lower(F.translate("t", ACCENTED, PLAIN)), r"[^a-z0-9|]+", " "))
    bare = F.replace(old, F.lit(" "), F.lit(""))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        old.alias("old"), ops.folded(F.col("t")).alias("new"), F.array(*[bare.rlike("|".join(w.replace(" ", "") for w in g)) for g in groups.values()]).alias("by_pattern"), F.array(*[ops._held(bare, g) for g in groups.values()]).alias("held")
    ).collect()
    assert [r.old for r in rows] == [r.new for r in rows] and [r.by_pattern for r in rows] == [r.held for r in rows]
    assert any(any(r.held) for r in rows if r.old)
