"""Small cases of single operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, loans, text
from ledgerloom.operators import finance, statements, texts
from ledgerloom.sources import tables
from ledgerloom.streaming import audit


def test_payments(spark):
    rows = [(500000.0, 0.0, 20, 4.5), (120000.0, 0.0, 10, 0.0), (100000.0, 100000.0, 10, 5.0), (0.0, 0.0, 10, 5.0), (None, 0.0, 10, 5.0)]
    d = spark.createDataFrame(rows, "p double, c double, y int, r double")
    got = [(r.payment, r.error) for r in finance.loan_payments(d, F.col("p"), F.col("c"), F.col("y"), F.col("r")).collect()]
    assert got == [(3163.25, None), (1000.0, None), (0.0, None), (None, "price"), (None, "not_finite")]


def test_discrepancy_thresholds(spark):
    rows = [(6000.0, 6000.0), (6000.0, 6600.0), (6000.0, 7000.0), (6000.0, 9000.0), (0.0, 0.0), (0.0, 500.0), (None, 500.0)]
    d = spark.createDataFrame(rows, "d double, e double")
    got = [(r.passed, r.severity) for r in finance.discrepancies(d, F.col("d"), F.col("e")).collect()]
    assert got == [(True, "information"), (True, "information"), (False, "avertissement"), (False, "critique"), (True, None), (False, None), (None, None)]


def test_default_durations(spark):
    got = {r.y: list(r.d) for r in spark.range(5, 31).select(F.col("id").alias("y"), loans.default_durations(F.col("id")).alias("d")).collect()}
    assert got[5] == [5, 10, 15] and got[20] == [15, 20, 25] and got[30] == [20, 25, 30] and got[8] == [5, 8, 13] and got[7] == [7, 12, 17]


def test_year_is_the_nearest(spark):
    d = spark.sql("select array(date'2019-12-31') a")
    assert str(d.select(dates.year_for(F.lit(7), F.lit(1), F.col("a")).alias("d")).first().d) == "2020-01-07"
    assert d.select(dates.force_month(F.lit(31), F.lit("2023-02")).alias("d")).first().d is None


def test_greedy_chunks_keep_all_text(spark):
    d = spark.createDataFrame([(1, "a" * 30 + "\n" + "b" * 95 + "\n" + "c" * 10), (2, ""), (3, None), (4, "x")], "id int, t string")
    got = [(r.id, r.chunk_id, r.chunk) for r in texts.greedy_chunks(d, "id", "t", 40, 10).orderBy("id", "chunk_id").collect()]
    assert [c for i, _, c in got if i == 1] == ["a" * 30, "b" * 40, "b" * 40, "b" * 35, "b" * 5, "c" * 10]
    assert [c for i, _, c in got if i == 4] == ["x"]
    with pytest.raises(ValueError):
        texts.fixed_chunks(d, "id", "t", 10, 10)


def test_search_takes_every_hundredth_row_in_blocks(spark, tmp_path, monkeypatch):
    from ledgerloom import plans

    monkeypatch.setattr(texts, "QUERY_BLOCK", 7)
    monkeypatch.setattr(texts, "VECTOR_BLOCK", 300)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)] if i % 5 else [1.0, 0.0, 0.5, 0.0, 0.0, 0.0]) for i in range(2500)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    held = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    got = {(r.query, r["rank"]): (r.vec_id, r.score) for r in plans.queries()["vector_topk"](spark, str(tmp_path)).collect()}
    assert {q for q, _ in got} == set(range(0, 2500, 100)) and len(got) == 125
    for query, vector in held:
        if query % 100 == 0:
            best = sorted((-round(sum(x * y for x, y in zip(vector, other, strict=True)), 6), i) for i, other in held if i != query)[:5]
            assert [got[query, n + 1][0] for n in range(5)] == [i for _, i in best]
            assert [got[query, n + 1][1] for n in range(5)] == pytest.approx([-s for s, _ in best], abs=1.1e-6)


def test_status_reads_events_of_all_days(spark, tmp_path):
    from ledgerloom import plans

    rows = [(1, 11, "view", 200.0, "2024-01-02"), (2, 11, "signup", 160.0, "2024-03-09"), (3, 11, "purchase", 170.0, "2025-12-31"), (4, 12, "view", 350.0, "2024-02-01"), (5, 13, "view", 151.0, "2024-01-06")]
    d = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, day string")
    d.selectExpr("event_id", "timestamp(day) ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: (r.status, r.n_done) for r in plans.queries()["dossier_status"](spark, str(tmp_path)).collect()}
    assert got == {11: ("ready", 3), 12: ("to_correct", 1), 13: ("to_check", 1)}
    counts = plans.queries()["dashboard_counts"](spark, str(tmp_path)).first().asDict()
    assert counts == {"total": 3, "ready": 1, "to_check": 1, "to_correct": 1, "complete": 1}


def test_keywords_in_cells_on_separate_lines(spark):
    d = spark.createDataFrame([("a", 1, "04/05/2023\nPRÉLÈVEMENT\nASSURANCE\n310,50"), ("a", 2, "PRELEVEMENT\n" + "x" * 180 + "\n99,00"), ("b", 1, "04/05/2023 " + "x" * 140 + " PRELEVEMENT 5,00\nrien")], "k string, page int, t string")
    docs = d.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("t"))
    got = [(r.k, r.page, str(r.date), r.description, r.amount) for r in statements.keyword_evidence(d, docs, "k", "page", "t", "prelevement").orderBy("k").collect()]
    assert got == [("a", 1, "2023-05-04", "prelevement assurance", 310.5), ("b", 1, "2023-05-04", "x" * 140 + " prelevement", 5.0)]


def test_banks_outside_the_catalogue(spark):
    d = spark.createDataFrame([("[PAGE 1]\nRELEVE\nUNION ATLAS  BANK - agence",), ("l\n" * 20 + "UNION ATLAS BANK",), ("CIH\nUNION ATLAS BANK",), ("BMCI",), (None,)], "t string")
    assert [r.b for r in d.select(statements.bank_name(F.col("t")).alias("b")).collect()] == ["UNION ATLAS BANK", None, "CIH Bank", "BMCI", None]


def test_banks_of_the_catalogue(spark):
    named = {"Société générale": "Société Générale", "SOCIETE GENERALE": "Société Générale", "credit agricole": "Crédit Agricole du Maroc", "Crédit du Maroc": None, "socihomme": None, "Attijariwafabank": "Attijariwafa bank", "bmce": "Bank of Africa", "BANQUE POPULAIRE": "Banque Populaire"}
    d = spark.createDataFrame([(t,) for t in named], "t string")
    assert {r.t: r.b for r in d.select("t", statements.bank_name(F.col("t")).alias("b")).collect()} == named


def test_words_a_little_like_sent(spark):
    d = spark.createDataFrame([(1, "VIREMENT RECU DE TEMPS"), (2, "VIREMENT RECU DE EM"), (3, "VIREMENT EMIS"), (4, "RECU DE ATELIER"), (5, None)], "k int, t string")
    got = {r.k: (r.incoming, r.outgoing) for r in statements.direction(d, "k", "t").collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(True, True), (True, False), (False, True), (True, False)] and not got[5][0] and not got[5][1]


def test_pdf_signature_has_five_bytes(spark):
    d = spark.createDataFrame([("a.pdf", 9, "2550444620"), ("b.pdf", 9, "255044462D31")], "path string, length int, head string")
    assert [r.valid for r in tables.file_control(d, 100).orderBy("path").collect()] == [False, True]


def test_merge_is_not_transitive(spark):
    rows = [("d", 0, i, 1, "01/01", 5.0, t, f"q{i}") for i, t in enumerate(["b", "a b c", "a", "c"])]
    d = spark.createDataFrame(rows, "doc_id string, priority int, pos int, page int, date string, amount double, description string, quote string")
    assert sorted(r.pos for r in statements.merge_evidence(d, "doc_id").collect()) == [0, 2, 3]


def test_folding(spark):
    d = spark.createDataFrame([("  Été\tà  Noël ",)], "t string")
    assert d.select(text.fold(F.col("t")).alias("t")).first().t == "ete a noel"


def test_csv_sink_escapes(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "out"), ";")
    assert spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path / "out")).first().a == "'=1"


def test_csv_sink_marks_utf8(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("é", 2)], "a string, b int").coalesce(1), str(tmp_path / "out"), ",", mark=True)
    raw = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert raw.decode("utf-8-sig").splitlines() == ["a,b", "é,2"] and raw.startswith(b"\xef\xbb\xbf")


def test_stream_keeps_each_event_once(spark, tmp_path):
    rows = spark.sql("select 1L event_id, timestamp'2024-01-01 10:00:00' ts, 5L user_id, 'view' event_type, 1.5D value, '{}' props")
    rows.union(rows).write.mode("append").parquet(str(tmp_path / "in"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    audit.append_log(audit.unique_events(audit.landed_events(spark, str(tmp_path / "in"))), str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "o_orderkey"
