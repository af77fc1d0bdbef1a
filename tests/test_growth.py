"""What keeps the cost of queries in step with their input: their plans, and results on rows that the tables lack."""

from __future__ import annotations

from ledgerloom import plans
from tests.test_oracle import SF

QUERIES = plans.queries()


def planned(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_layout_rows_calls_no_function_a_page(spark):
    from ledgerloom.operators.layout import TOKENS, layout_rows

    plan = planned(spark, "layout_rows")
    assert "FlatMapGroups" not in plan and plan.count("Relation") == 1
    tokens = [("p", "b", 50.0, 0.0, 60.0, 10.0), ("p", "a", 0.0, 1.0, 10.0, 11.0), ("p", "DEBIT", 100.0, 40.0, 120.0, 50.0), ("p", "credit ", 200.0, 41.0, 220.0, 51.0), ("p", "1,00", 205.0, 80.0, 215.0, 90.0), ("p", "2,00", 105.0, 81.0, 115.0, 91.0), (None, "x", 0.0, 0.0, 1.0, 10.0)]
    rows = layout_rows(spark.createDataFrame(tokens, f"page string, {TOKENS}"), "page").collect()
    assert sorted(((r.page or "", r.row, r.line) for r in rows)) == [("", 0, "x"), ("p", 0, "a | b"), ("p", 1, "DEBIT | credit "), ("p", 2, "DEBIT: 2,00 | CREDIT: 1,00")]


def test_box_dedupe_calls_no_function_a_page(spark):
    from ledgerloom.operators.layout import box_dedupe

    assert "FlatMapGroups" not in planned(spark, "box_dedupe")
    boxes = [("p", "sure", 0.9, 0.0, 0.0, 10.0, 10.0), ("p", "same", 0.8, 1.0, 1.0, 10.0, 10.0), ("p", "beside", None, 20.0, 0.0, 30.0, 10.0), ("p", "over it", 0.1, 20.0, 0.0, 29.0, 10.0), ("p", "half", 0.7, 5.0, 0.0, 15.0, 10.0), ("p", "empty", 0.5, 50.0, 0.0, 50.0, 10.0), ("q", "sure", 0.1, 0.0, 0.0, 10.0, 10.0)]
    rows = box_dedupe(spark.createDataFrame(boxes, "page string, text string, confidence double, x0 double, y0 double, x1 double, y1 double"), "page").collect()
    assert sorted((r.page, r.text) for r in rows) == [("p", "half"), ("p", "over it"), ("p", "sure"), ("q", "sure")]


def test_passages_give_no_candidates_that_are_not_found(spark):
    from ledgerloom.operators.evidence import Passages

    for name in ("passage_search", "provenance"):
        plan = planned(spark, name)
        assert "FlatMapCoGroups" in plan and "array_distinct" not in plan
    asked = ["ab", "b", "b a", "a  b", "x ab y", "x ab q y", "ab q"]
    texts = ["ab", "cab abc", "a  b", "zx ab yz", "zx ab q yz", "x ab qy", ""]
    found = Passages(asked).found
    assert [{asked[n] for n in found(t)} for t in texts] == [{a for a in asked if a in t} for t in texts]


def test_labels_are_read_in_one_pass(spark):
    plan = planned(spark, "label_value")
    assert plan.count("lead(") == 3 and "Union" not in plan and plan.count("Relation") == 1


def test_rows_without_amount_joins_no_buckets(spark):
    from ledgerloom.operators.geometry import rows_without_amount

    plan = planned(spark, "rows_without_amount")
    assert plan.count("Join ") == 1 and "_band" not in plan
    token = lambda page, at, text, x, y, h: (page, at, text, x, y - h / 2, x + 20.0, y + h / 2, 800)
    heads = lambda page: [token(page, 0, "Débit", 400.0, 10.0, 10.0), token(page, 1, "Crédit", 500.0, 10.0, 10.0)]
    tokens = [*heads(1), token(1, 2, "virement reçu", 100.0, 100.0, 10.0), token(1, 3, "12,00", 510.0, 122.0, 10.0), token(1, 4, "versement", 100.0, 300.0, 10.0), token(1, 5, "12,00", 510.0, 323.0, 10.0), token(1, 6, "remise cheque", 100.0, 500.0, 10.0), token(1, 7, "1 200,00 DH", 410.0, 500.0, 10.0)]
    tokens += [*heads(2), token(2, 2, "versement", 100.0, 5.0, 10.0), token(2, 3, "versement", 100.0, 400.0, 10.0), token(2, 4, "9,00", 510.0, 440.0, 20.0), token(3, 2, "versement", 100.0, 400.0, 10.0)]
    rows = rows_without_amount(spark.createDataFrame(tokens, "pg int, at int, text string, x0 double, y0 double, x1 double, y1 double, width int"), "pg", "at", "width").collect()
    assert sorted((r.pg, r.row) for r in rows) == [(1, 4), (1, 6)]


def test_messages_are_read_once(spark):
    plan = planned(spark, "chat_numbers")
    assert plan.count("regexp_extract(") == 8


def test_days_of_marked_lines_are_searched_once(spark):
    """The text before a line's mark and the days in it are columns of their own: no branch of the date searches them again."""
    plan = planned(spark, "column_transactions")
    assert plan.count("regexp_extract_all(") <= 3 and plan.count("Relation") <= 2


def test_monthly_charge_reads_each_evidence_once(spark):
    """Evidence is counted and chosen in one pass: no reading of the statements stands twice in the plan."""
    from ledgerloom.operators import income

    plan = planned(spark, "monthly_charge")
    assert plan.count("Relation") <= 9
    assert plan.count("RLIKE (?im)^.*") <= 2
    docs = [(1, "[PAGE 1]\n01/02/2020 | RETRAIT GUICHET | DEBIT: 10,00"), (2, "[PAGE 1]\n01/02/2020 | ECHEANCE CREDIT AUTO | DEBIT: 20,00\n01/03/2020 | ECHEANCE CREDIT AUTO | DEBIT: 22,00"), (3, "[PAGE 1]\nnothing"), (4, "[PAGE 1]\n01/02/2020 | PRET | 5,00")]
    docs = spark.createDataFrame(docs, "k int, text string")
    pages = docs.selectExpr("k", "1 page", "replace(text, '[PAGE 1]\n', '') text")
    items = spark.createDataFrame([(4, 1, 1, "debit", "01/02/2020", "MENSUALITE PRET", "5,00", "01/02/2020 | PRET | 5,00"), (3, 1, 1, "debit", "01/02/2020", "MENSUALITE PRET", "5,00", "is not there")], "k int, pos int, page int, type string, date string, description string, amount string, quote string")
    rows = income.monthly_charge(docs, pages, items, "k", "text").collect()
    assert sorted(map(tuple, rows)) == [(1, 0.0, 0.35, 0, True), (2, 21.0, 0.5, 2, False), (4, 5.0, 0.5, 1, False)]


def test_only_words_that_may_be_like_a_target_are_compared(spark):
    from ledgerloom.operators import statements as ops

    targets = dict(ops.MISREAD) | ops.DIRECTIONS
    words = ["virement", "virenent", "vire", "emis", "emiz", "abegil", "mutuele", "ment", "mmmmmm", "versements", "recue", "r", "receptian", "indemnisationss"]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", *[ops.may_be_like(ops.F.col("word"), t, v).alias(t) for t, v in targets.items()]).collect()
    like = {(w, t) for w in words for t, v in targets.items() if ops.likeness(w, t) >= v}
    may = {(r.word, t) for r in rows for t in targets if r[t]}
    assert like <= may and len(may) < len(words) * len(targets) / 4
    near = ops.similar_words(spark.createDataFrame(list(enumerate(words)), "k int, t string"), "k", "t", targets).collect()
    assert {(words[r.k], r.name) for r in near} == {(w, t) for w, t in like if len(w) > 1}


def test_lines_with_keywords_are_searched_once(spark):
    plan = planned(spark, "keyword_evidence")
    assert plan.count("regexp_extract_all(line") == 2 and plan.count("regexp_extract_all(head") == 1


def test_totals_are_cut_out_once_and_texts_dealt(spark):
    from ledgerloom.operators.payslips import pay_totals

    plan = planned(spark, "payslip_totals")
    assert "RepartitionByExpression" in plan and plan.count("regexp_extract(_text") == 6
    texts = ["TOTAL BRUT : 1.234,50 Net à payer | 1 000,00", "ſalaire brut 12,00", "Total retenues - 3,00\nTRAITEMENT DE BASE 100,00 900,00", None, ""]
    rows = pay_totals(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("k").collect()
    assert [tuple(r)[1:] for r in rows] == [(1234.5, None, None, 1000.0, None), (12.0, None, None, None, None), (None, None, 3.0, None, 900.0), (None,) * 5, (None,) * 5]
