"""Literal rows through operators of the library, with the results that they must give as SQL; run by test_literal_cases.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers
from ledgerloom.functions import text as T
from ledgerloom.operators import confirmation, conversation, identity, layout, statements

QUERIES, ORACLE = {}, {}


def literal(rows: list[tuple]) -> str:
    """Rows as SQL VALUES."""
    one = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def expected(rows: list[tuple], columns: str) -> str:
    """SQL that returns known results: casts and names in `columns` as "name type, ..."."""
    parts = [c.split() for c in columns.split(", ")]
    return f"select {', '.join(f'v{i}::{t} as {chr(34)}{n}{chr(34)}' for i, (n, t) in enumerate(parts))} from {literal(rows)} t({', '.join(f'v{i}' for i in range(len(parts)))})"


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


AMOUNTS = [("1 234,56 MAD", 1234.56, None), ("1.234,56", 1234.56, None), ("1,234.56", 1234.56, None), ("12.500", 12500.0, 12.5), ("12,500", 12500.0, 12.5), ("7,5 DH", 7.5, 7.5), ("1.500,00", 1500.0, None), ("12d", 12.0, 12.0), ("", None, None), ("abc", None, None), ("-1", -1.0, -1.0), ("6 500,50", 6500.5, 6500.5)]
AMOUNT_ROWS = [(r, s, None if r in ("1 234,56 MAD", "1.234,56", "1,234.56", "1.500,00") and r != "1 234,56 MAD" else 1234.56 if r == "1 234,56 MAD" else lo) for r, s, lo in AMOUNTS]


@query(expected(AMOUNT_ROWS, "raw varchar, strict double, loose double"))
def amount_parse(spark, sf_dir):
    d = frame(spark, [(r,) for r, *_ in AMOUNTS], "raw string")
    return d.select("raw", numbers.strict_amount(F.col("raw")).alias("strict"), numbers.loose_amount(F.col("raw")).alias("loose"))


DATES = [("01/02/2020", "2020-02-01"), ("2020-02-01", "2020-02-01"), ("31/02/2020", None), ("01-02-2020", "2020-02-01"), ("2999-01-01", "2999-01-01"), ("", None), ("1/2/20", None)]


@query(expected(DATES, "raw varchar, day varchar"))
def date_parse(spark, sf_dir):
    return frame(spark, [(r,) for r, _ in DATES], "raw string").select("raw", F.date_format(dates.parse_date(F.col("raw")), "yyyy-MM-dd").alias("day"))


EMAILS = [(" Ana.B@Example.COM ", "ana.b@example.com", True), ("no-at.example.com", "no-at.example.com", False), ("a@b", "a@b", False), ("x y@example.org", "x y@example.org", False)]


@query(expected(EMAILS, "raw varchar, email varchar, valid boolean"))
def email_valid(spark, sf_dir):
    return frame(spark, [(r,) for r, *_ in EMAILS], "raw string").select("raw", T.normal_email(F.col("raw")).alias("email"), T.valid_email(F.col("raw")).alias("valid"))


CELLS = [("=1+2", "'=1+2"), (" +3", "' +3"), ("plain", "plain"), ("-x", "'-x"), ("a=b", "a=b"), ("@me", "'@me"), ("", "")]


@query(expected(CELLS, "raw varchar, cell varchar"))
def csv_escape(spark, sf_dir):
    return frame(spark, [(r,) for r, _ in CELLS], "raw string").select("raw", T.csv_cell(F.col("raw")).alias("cell"))


#: Invented statements; amounts and noise as the operators must stand them.
STATEMENT = [
    ("s1", "SOLDE DEPART AU 31/08/2023 | CREDIT: 13.175,79"),
    ("s1", "01/09 | 02/09/2023 | VIREMENT RECU DE ATELIER NORD | CREDIT: 500,00"),
    ("s1", "05/09 | 05/09/2023 | VIREMENT RECU DE ATELIER SUD | CREDIT: 250,00"),
    ("s1", "09/09 | 09/09/2023 | PRELEVEMENT ECHEANCE CREDIT | DEBIT: 1 200,00"),
    ("s1", "12/09 | 12/09/2023 | RETRAIT GUICHET | DEBIT: 300,00"),
    ("s2", "RELEVE DU 01/03/2024 AU 31/03/2024 CIH BANK"),
    ("s2", "07 03 VIREMENT RECU DE MAISON BLEUE 4 150,00"),
    ("s2", "09 03 VIRSNENT RECD DE JARDIN 180,00"),
    ("s2", "11 03 VIREMENT EMIS EN FATEUR DE GARAGE 90,00"),
    ("s2", "02/04/2024 VIREMENT RECU DE AUTRE MOIS | CREDIT: 77,00"),
]


def _lines(spark):
    return frame(spark, [(d, i, r) for i, (d, r) in enumerate(STATEMENT)], "doc_id string, line_no int, raw string")


def _docs(spark):
    texts = {}
    for d, r in STATEMENT:
        texts[d] = texts.get(d, "") + r + "\n"
    return frame(spark, list(texts.items()), "doc_id string, text string")


@query(expected([("s1", "2023-09"), ("s2", "2024-03")], "doc_id varchar, month varchar"))
def statement_month(spark, sf_dir):
    return statements.statement_month(_docs(spark), "doc_id", "text")


@query(expected([("s1", "2023-09-01", "VIREMENT RECU DE ATELIER NORD", 500.0), ("s1", "2023-09-05", "VIREMENT RECU DE ATELIER SUD", 250.0)], "doc_id varchar, day varchar, description varchar, amount double"))
def column_transactions(spark, sf_dir):
    out = statements.column_transactions(_lines(spark), _docs(spark), "doc_id", "text", "raw", "credit")
    return out.select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "description", "amount")


@query(expected([("s2", "2024-03-07", 4150.0), ("s2", "2024-03-09", 180.0)], "doc_id varchar, day varchar, amount double"))
def fuzzy_transactions(spark, sf_dir):
    return statements.fuzzy_transactions(_lines(spark).where("raw not like '%CREDIT:%' and raw not like '%DEBIT:%'"), _docs(spark), "doc_id", "text", "raw").select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "amount")


@query(expected([("s1", "09/09", 1200.0)], "doc_id varchar, date_text varchar, amount double"))
def keyword_transactions(spark, sf_dir):
    return statements.keyword_transactions(_lines(spark), "doc_id", "raw", "prelevement|echeance").select("doc_id", "date_text", "amount")


#: A page whose cells lie on separate lines, and one with the cells of a table.
SPLIT = [("k1", 1, "RELEVE DU 01/05/2023 AU 31/05/2023\n04/05\nPRELEVEMENT ASSURANCE\nREF AB\n310,50\n"), ("k2", 1, "RELEVE DU 01/06/2023 AU 30/06/2023\n03/06 | ECHEANCE PRET | 800,00\n")]


@query(expected([("s1", 1, "09/09", 1200.0), ("s1", 1, "09/09/2023", 1200.0), ("k1", 1, "04/05", 310.5), ("k2", 1, "03/06", 800.0)], "doc_id varchar, page integer, date_text varchar, amount double"))
def keyword_evidence(spark, sf_dir):
    pages = _docs(spark).select("doc_id", F.lit(1).alias("page"), "text").union(frame(spark, SPLIT, "doc_id string, page int, text string"))
    return statements.keyword_evidence(pages, pages, "doc_id", "page", "text", "prelevement|echeance").select("doc_id", "page", "date_text", "amount")


@query(expected([("s1", "2023-09-07"), ("s2", "2024-03-07")], "doc_id varchar, day varchar"))
def transaction_date(spark, sf_dir):
    a = statements.anchor_dates(_docs(spark), "doc_id", "text")
    raw = F.when(F.col("doc_id") == "s1", "07/09").otherwise("07 03")
    return a.select("doc_id", F.date_format(statements.operation_date(raw, F.col("anchors")), "yyyy-MM-dd").alias("day"))


@query(expected([("s1", "2023-08-31", 13175.79)], "doc_id varchar, day varchar, balance double"))
def balance_line(spark, sf_dir):
    return statements.balance_lines(_docs(spark), "doc_id", "text", "SOLDE DEPART").select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("day"), F.col("balance").alias("balance"))


@query(expected([("s1", None), ("s2", "CIH Bank")], "doc_id varchar, bank varchar"))
def bank_name(spark, sf_dir):
    return _docs(spark).select("doc_id", statements.bank_name(F.col("text")).alias("bank"))


@query(expected([("s1", "2023-09-01", "2023-09-30", 0.66), ("s2", "2024-03-01", "2024-03-31", 0.95)], "doc_id varchar, start varchar, end varchar, confidence double"))
def period_bounds(spark, sf_dir):
    p = statements.period_bounds(_docs(spark), "doc_id", "text")
    return p.select("doc_id", F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"), "confidence")


@query(expected([("s1", None, "2023-09-01", 750.0, 1200.0), ("s2", "CIH Bank", "2024-03-01", None, None)], "doc_id varchar, bank varchar, start varchar, credits double, charges double"))
def statement_header(spark, sf_dir):
    total = lambda kind, name: statements.column_transactions(_lines(spark), _docs(spark), "doc_id", "text", "raw", kind).where(F.lit(kind) == "credit" if kind == "credit" else F.col("description").rlike("ECHEANCE")).groupBy("doc_id").agg(F.round(F.sum("amount"), 2).alias(name))
    head = _docs(spark).select("doc_id", statements.bank_name(F.col("text")).alias("bank")).join(period_bounds(spark, sf_dir).select("doc_id", "start"), "doc_id")
    return head.join(total("credit", "credits"), "doc_id", "left").join(total("debit", "charges"), "doc_id", "left")


OPERATIONS = [
    (1, "VIREMENT RECU DE ATELIER", None, True, False), (2, "Remboursement mutuelle", EX := "remboursement ou indemnisation ponctuelle", True, False), (3, "HUTOELLE CENTRALE", EX, False, False),
    (4, "COMMISSION VIREMENT EMIS", "dépense ou opération technique", False, True), (5, "VIRSNENT RECD DE JARDIN", None, True, False), (6, "VIREMENT EN FATEUR DE X", None, False, True), (7, "SALAIRE MARS", "salaire déjà pris en compte par le bulletin de paie", False, False),
]


def _operations(spark):
    return frame(spark, [(i, t) for i, t, *_ in OPERATIONS], "op int, label string")


@query(expected([(i, r) for i, _, r, *_ in OPERATIONS], "op integer, reason varchar"))
def income_exclusion(spark, sf_dir):
    return statements.income_exclusion(_operations(spark), "op", "label").select("op", "reason")


@query(expected([(i, inc, out) for i, _, _, inc, out in OPERATIONS], "op integer, incoming boolean, outgoing boolean"))
def incoming_flag(spark, sf_dir):
    return statements.direction(_operations(spark), "op", "label").select("op", "incoming", "outgoing")


@query(expected([("virenent", 0.875), ("virement", 1.0), ("recd", 0.75)], "word varchar, ratio double"))
def fuzzy_match(spark, sf_dir):
    d = frame(spark, [("virenent", "virement|versement"), ("virement", "virement"), ("recd", "recu")], "word string, targets string")
    return d.select("word", F.round(statements.best_likeness("word", "targets"), 6).alias("ratio"))


EVIDENCE = [
    ("d1", 0, 0, 1, "01/09", 500.0, "Virement recu Atelier", "a 500"), ("d1", 1, 0, 1, "01/09", 500.0, "virement recu atelier nord", "b 500"), ("d1", 1, 1, 1, "05/09", 250.0, "Virement", "c 250"), ("d1", 2, 0, 1, "06/09", 250.0, "Virement", "C  250"), ("d2", 0, 0, 1, "01/09", -5.0, "Frais", "f"),
]
EVIDENCE_SCHEMA = "doc_id string, priority int, pos int, page int, date string, amount double, description string, quote string"


@query(expected([("d1", 0, 0), ("d1", 1, 1), ("d2", 0, 0)], "doc_id varchar, priority integer, pos integer"))
def merge_evidence(spark, sf_dir):
    return statements.merge_evidence(frame(spark, EVIDENCE, EVIDENCE_SCHEMA), "doc_id").select("doc_id", "priority", "pos")


@query("select doc_id, date, substring(sha256(concat_ws('|', page::varchar, date, printf('%.2f', amount), lower(description), lower(quote))), 1, 16) candidate_id from " + literal([("d1", 1, "01/09", 500.0, "Virement recu Atelier", "a 500"), ("d1", 1, "05/09", 250.0, "Virement", "c 250")]) + " t(doc_id, page, date, amount, description, quote)")
def credit_candidates(spark, sf_dir):
    merged = statements.merge_evidence(frame(spark, EVIDENCE, EVIDENCE_SCHEMA), "doc_id")
    return statements.credit_candidates(merged, "doc_id").select("doc_id", "date", "candidate_id")


CARDS = [("c1", "IDMAR<<AB123456<7<\n850214 5M320420 1MAR<<<\nEL<<BAROUDI<<<NADIM<<"), ("c2", "no zone here"), ("c3", "IDMAR<X98765<\n0503031F2811115MAR<<0TAZICCLINA")]


@query(expected([("c1", "AB123456", "14/02/1985", "M", "20/04/2032", "EL BAROUDI", "NADIM"), ("c3", "X98765", "03/03/2005", "F", "11/11/2028", "TAZI", "LINA")], "doc_id varchar, cin varchar, birth varchar, sex varchar, expiry varchar, surname varchar, given varchar"))
def mrz_parse(spark, sf_dir):
    return identity.mrz_fields(frame(spark, CARDS, "doc_id string, text string"), "doc_id", "text", "2026-01-01")


@query(expected([("c1", "AB123456", "BAROUDI"), ("c3", "X98765", "TAZI"), ("c4", "K11111", "SEUL")], "doc_id varchar, cin varchar, surname varchar"))
def identity_fields(spark, sf_dir):
    seen = frame(spark, [("c1", None, "BAROUDI"), ("c4", "K11111", "SEUL")], "doc_id string, cin string, surname string")
    return identity.merged_identity(seen, mrz_parse(spark, sf_dir), "doc_id", ["cin", "surname"])


@query(expected([(1, "F", "AB12345", "TAZI", "12 rue des Lilas", ""), (2, None, None, None, None, "sex|cin|surname|address"), (3, "M", None, None, None, "")], "id integer, sex varchar, cin varchar, surname varchar, address varchar, rejected varchar"))
def identity_safety(spark, sf_dir):
    d = frame(spark, [(1, "Féminin", "ab 12345", "TAZI", "12 rue des Lilas"), (2, "?", "123", "Maroc", "AB12345"), (3, "Masculin", None, None, None)], "id int, sex string, cin string, surname string, address string")
    return identity.identity_safety(d)


SLIP = [("p1", 1, "Employeur | ATELIER NORD SARL"), ("p1", 2, "Poste | Date d'embauche"), ("p1", 3, "Technicien | 01/02/2020"), ("p1", 4, "NET A PAYER : 6 000,00"), ("p1", 5, "Periode : 03/2024")]


@query(expected([("p1", "employeur", "ATELIER NORD SARL"), ("p1", "poste", "Date d'embauche"), ("p1", "net", "6 000,00"), ("p1", "embauche", "01/02/2020")], "doc_id varchar, field varchar, value varchar"))
def label_value(spark, sf_dir):
    labels = {"employeur": "^employeur", "poste": "^poste", "net": "net a payer", "embauche": "^date d.embauche"}
    return identity.label_values(frame(spark, SLIP, "doc_id string, line_no int, raw string"), "doc_id", "line_no", "raw", labels)


@query(expected([("p1", "net", "6 000,00", 0.9), ("p1", "periode", "03/2024", 0.8)], "doc_id varchar, field varchar, value varchar, confidence double"))
def payslip_fields(spark, sf_dir):
    layouts = [("net", r"(?i)net\s+a\s+payer\s*:?\s*(\d[\d ]*,\d{2})", 0.9), ("net", r"(\d[\d ]*,\d{2})", 0.5), ("periode", r"(?i)periode\s*:\s*(\d{2}/\d{4})", 0.8)]
    return identity.payslip_fields(frame(spark, SLIP, "doc_id string, line_no int, raw string"), "doc_id", "line_no", "raw", layouts)


MESSAGES = [(1, "Je veux simuler un crédit", "guidance", False), (2, "Bonjour !", "conversation", False), (3, "Quels documents faut-il ?", "rag", True), (4, "Comment estimer ma mensualité ?", "rag", True), (5, "le délai est long", "rag", True)]


@query(expected(MESSAGES, "id integer, message varchar, mode varchar, documentation boolean"))
def chat_route(spark, sf_dir):
    return conversation.route(frame(spark, [(i, m) for i, m, *_ in MESSAGES], "id int, message string"), "message", F.lit(False))


ASKED = "Indiquez la durée du prêt, le montant du financement et le taux d'intérêt."


@query(expected([(1, 15, 386000.0, 4.5), (2, None, None, None), (3, None, None, None), (4, 20, 500000.0, 4.25)], "id integer, years integer, amount double, rate double"))
def chat_triple(spark, sf_dir):
    d = frame(spark, [(1, "15 ans, 386000, 4.5", ASKED), (2, "2 ans, 386000, 45", ASKED), (3, "15 ans, 386000, 4.5", "autre"), (4, "20 ans, 500000, 4,25", ASKED)], "id int, message string, previous string")
    return conversation.follow_up(d, "message", "previous").select("id", "years", "amount", "rate")


@query(expected([(1, "revenu_mensuel_net", 12000.0), (1, "apport_personnel", 150000.0), (2, "prix_bien", None)], "id integer, field varchar, value double"))
def chat_numbers(spark, sf_dir):
    d = frame(spark, [(1, "mon salaire est 12 000 et un apport de 150 k"), (2, "le prix: 1.200.000")], "id int, message string")
    return conversation.money_slots(d, "id", "message")


PROFILES = [(1, "infirmier", None, None, 3.0), (2, None, "cdi", "public", None)]
PROFILE_SCHEMA = "id int, profession string, statut string, secteur string, anciennete double"


@query(expected([(1, "statut", "statut"), (2, "profession", "profession|anciennete")], "id integer, next varchar, missing varchar"))
def profile_missing(spark, sf_dir):
    return conversation.missing_slots(frame(spark, PROFILES, PROFILE_SCHEMA), "id", ("profession", "statut", "secteur", "anciennete"), ("secteur",))


@query(expected([(1, "infirmier", 5.0), (2, "avocat", None)], "id integer, profession varchar, anciennete double"))
def profile_update(spark, sf_dir):
    new = frame(spark, [(1, " ", 5.0), (2, " avocat ", -1.0)], "id int, profession string, anciennete double")
    return conversation.updated_profile(frame(spark, PROFILES, PROFILE_SCHEMA), new, "id", ["profession", "anciennete"])


TOKENS = [("g", "DEBIT", 600, 0, 680, 12), ("g", "CREDIT", 720, 0, 810, 12), ("g", "01/09", 10, 20, 60, 30), ("g", "VIREMENT A", 100, 20, 300, 30), ("g", "500,00", 730, 20, 800, 30), ("g", "02/09", 10, 36, 60, 46), ("g", "VIREMENT B", 100, 36, 300, 46), ("g", "250,00", 730, 36, 800, 46)]


@query(expected([("g", 0, "DEBIT | CREDIT"), ("g", 1, "01/09 | VIREMENT A | CREDIT: 500,00"), ("g", 2, "02/09 | VIREMENT B | CREDIT: 250,00")], "page varchar, row integer, line varchar"))
def layout_rows(spark, sf_dir):
    d = frame(spark, [(p, t, *map(float, b)) for p, t, *b in TOKENS], "page string, text string, x0 double, y0 double, x1 double, y1 double")
    return layout.layout_rows(d, "page")


@query(expected([("g", "500,00"), ("g", "x")], "page varchar, text varchar"))
def box_dedupe(spark, sf_dir):
    d = frame(spark, [("g", "500,00", 0.9, 0.0, 0.0, 10.0, 10.0), ("g", "5OO,00", 0.6, 1.0, 0.0, 10.0, 10.0), ("g", "x", 0.5, 20.0, 0.0, 30.0, 10.0)], "page string, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    return layout.box_dedupe(d, "page").select("page", "text")


@query(expected([(1, "2023-09-01", True), (2, "2023-09-05", False)], "item integer, date varchar, found boolean"))
def transaction_evidence(spark, sf_dir):
    items = frame(spark, [(1, "s1", "2023-09-01", "500,00", "atelier nord"), (2, "s1", "2023-09-05", "999,00", "atelier sud")], "item int, doc_id string, date string, amount string, words string")
    page = T.fold(F.col("text"))
    tokens = F.split("words", " ")
    forms = F.array(F.date_format("date", "dd/MM/yyyy"), F.date_format("date", "dd/MM"))
    found = F.exists(forms, lambda f: page.contains(f)) & page.contains(F.col("amount")) & (F.size(F.filter(tokens, lambda t: page.contains(t))) >= F.least(F.lit(2), F.size(tokens)))
    return items.join(_docs(spark), "doc_id").select("item", "date", found.alias("found"))


RECORDS = [
    ("d1", "carte_identite", {"cin": "AB12345", "nom": "TAZI", "prenom": " ", "date_naissance": "31/02/1990"}), ("d2", "bulletin", {"date_embauche": "01/02/2030", "salaire_brut": "5000", "salaire_net": "6000"}),
    ("d3", "releve", {"charge_mensuelle_credits": "-1"}), ("d4", "compromis", {"vendeur_nom": "X", "prix_vente": "NaN", "date_signature": "2024-01-31"}),
]
RULED = [
    ("d1", "cin_format", True), ("d1", "nom_present", True), ("d1", "prenom_present", False), ("d1", "date_naissance", False), ("d2", "date_embauche", False), ("d2", "salaire_brut_positif", True), ("d2", "salaire_net_positif", True),
    ("d2", "net_inferieur_brut", False), ("d3", "charge_mensuelle_credits", False), ("d4", "acheteur_present", False), ("d4", "vendeur_present", True), ("d4", "prix_vente_positif", False), ("d4", "date_signature", True),
]


@query(expected(RULED, "doc_id varchar, rule varchar, passed boolean"))
def document_rules(spark, sf_dir):
    d = frame(spark, RECORDS, "doc_id string, kind string, fields map<string,string>")
    return confirmation.document_rules(d, "doc_id", "kind", "fields", "2026-01-01")


TYPED = [
    (1, "bulletin", "salaire_net", "6 500,50", "6000", "6500.5", None, "corrige"), (2, "bulletin", "salaire_net", "6000", "6 000", "6000.0", None, "confirme"), (3, "bulletin", "salaire_net", " ", "1", None, "required", None), (4, "bulletin", "salaire_net", "-1", "1", None, "amount", None),
    (5, "carte_identite", "date_naissance", "01/02/2020", None, "2020-02-01", None, "corrige"), (6, "carte_identite", "date_naissance", "31/02/2020", None, None, "date", None), (7, "carte_identite", "date_naissance", "2999-01-01", None, None, "future", None), (8, "compromis", "devise", "", None, None, None, "confirme"),
]


@query(expected([(i, v, e, s) for i, _, _, _, _, v, e, s in TYPED], "id integer, value varchar, error varchar, status varchar"))
def confirmed_field_values(spark, sf_dir):
    d = frame(spark, [r[:5] for r in TYPED], "id int, kind string, field string, raw string, original string")
    return confirmation.confirmed_values(d, "kind", "field", "raw", "original", "2026-01-01").select("id", "value", "error", "status")


@query(expected([("c1", "income", "9"), ("c2", "income", "5")], "customer varchar, field varchar, value varchar"))
def dossier_override(spark, sf_dir):
    records = frame(spark, [("c1", "income", "8", "2024-01-01", ["a", "b"]), ("c1", "income", "9", "2024-01-02", ["b", "a"]), ("c1", "income", "7", "2024-01-03", ["a"]), ("c2", "income", "5", "2024-01-01", ["z"])], "customer string, field string, value string, confirmed_at string, source_ids array<string>")
    return confirmation.dossier_override(records, frame(spark, [("c1", "a"), ("c1", "b"), ("c2", "z")], "customer string, source_id string"), "customer", "field")


CANONICAL = [("1 200,5", "number", "number:1200.50"), ("abc", "number", "text:abc"), ("01/02/2020", "date", "date:2020-02-01"), (" Été  Bleu ", "text", "text:ete bleu")]


@query(expected(CANONICAL, "raw varchar, expected varchar, canonical varchar"))
def canonical_values(spark, sf_dir):
    d = frame(spark, [r[:2] for r in CANONICAL], "raw string, expected string")
    return d.select("raw", "expected", confirmation.canonical(F.col("raw"), F.col("expected")).alias("canonical"))
