"""Queries on identity cards, labelled lines and guided conversations, written out from customers and orders; the SQL takes the results from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import conversation, identity
from ledgerloom.plans.fields import cases
from ledgerloom.plans.payslips import DIGITS, GIVEN, SURNAME, money, written
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CARDS = f"""c as (select c_custkey, lpad(c_custkey::varchar, 6, '0') n, date '1950-01-01' + (c_custkey % 20000)::integer born, date '2027-01-01' + (c_custkey % 3000)::integer expires, case when c_custkey % 2 = 0 then 'M' else 'F' end sex from customer),
p as (select *, translate(n, '{DIGITS}', '{SURNAME}') s, translate(n, '{DIGITS}', '{GIVEN}') g from c),
z as (select c_custkey, 'AB' || n cin, strftime(born, '%d/%m/%Y') birth, sex, strftime(expires, '%d/%m/%Y') expiry, case when c_custkey % 5 = 0 then 'EL ' else '' end || s surname, g given from p where c_custkey % 3 <> 2)"""


def _cards(spark, sf_dir):
    """(c_custkey, text): cards with a machine-readable zone; every third page has none."""
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 6, "0")
    day = lambda start, days: F.date_format(F.date_add(F.lit(start).cast("date"), (k % days).cast("int")), "yyMMdd")
    zone = written("recto\nIDMAR<<AB", n, "<7<\n", day("1950-01-01", 20000), " 5", F.when(k % 2 == 0, "M").otherwise("F"), day("2027-01-01", 3000), " 1MAR<<<\n", F.when(k % 5 == 0, "EL<<").otherwise(""), F.translate(n, DIGITS, SURNAME), "<<<", F.translate(n, DIGITS, GIVEN), "<<")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 != 2, zone).otherwise(written("page ", n)).alias("text"))


@query(f"with {CARDS} select * from z")
def mrz_parse(spark, sf_dir):
    return identity.mrz_fields(_cards(spark, sf_dir), "c_custkey", "text", "2026-01-01")


@query(f"with {CARDS}, v as (select c_custkey, case when c_custkey % 4 = 0 then 'K11111' end cin, 'SEEN ' || s surname from p where c_custkey % 2 = 0) select coalesce(v.c_custkey, z.c_custkey) c_custkey, coalesce(v.cin, z.cin) cin, coalesce(v.surname, z.surname) surname from v full join z on v.c_custkey = z.c_custkey")
def identity_fields(spark, sf_dir):
    """What is printed on every second card, before what its zone says."""
    k = F.col("c_custkey")
    seen = table(spark, sf_dir, "customer").where(k % 2 == 0).select("c_custkey", F.when(k % 4 == 0, "K11111").alias("cin"), F.concat(F.lit("SEEN "), F.translate(F.lpad(k.cast("string"), 6, "0"), DIGITS, SURNAME)).alias("surname"))
    return identity.merged_identity(seen, mrz_parse(spark, sf_dir), "c_custkey", ["cin", "surname"])


@query("""with c as (select c_custkey, c_custkey % 5 k, lpad(c_custkey::varchar, 6, '0') n from customer)
select c_custkey, case k when 0 then 'F' when 1 then 'M' when 4 then 'M' end sex, case when k in (0, 1) then 'AB' || n end cin, case k when 0 then 'TAZI' when 4 then 'Alami' end surname, case when k = 0 then '12 rue des Lilas ' || n end address,
case k when 0 then '' when 1 then 'surname|address' when 2 then 'sex|cin|surname|address' when 3 then '' else 'address' end rejected from c""")
def identity_safety(spark, sf_dir):
    k, n = F.col("c_custkey") % 5, F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "customer").select(
        "c_custkey", cases(k, F.lit("Féminin"), F.lit("masculin"), F.lit("?"), none, F.lit("h")).alias("sex"), cases(k, written("ab ", n), written("AB", n), F.lit("123"), none, none).alias("cin"),
        cases(k, F.lit("TAZI"), F.lit("Maroc"), F.lit("Carte"), none, F.lit("Alami")).alias("surname"), cases(k, written("12 rue des Lilas ", n), written("ab", n), F.lit("K1234567"), none, F.lit("court")).alias("address"),
    )
    return identity.identity_safety(d)


@query(f"""with {CARDS}, k as (select c_custkey, c_custkey % 4 k, n, s, g from p)
select c_custkey, 'cin' field, 'AB' || n as value, 0.86::double confidence, case k when 1 then 2 else 1 end page from k where k <> 3
union all select c_custkey, 'adresse', case k when 0 then 'RUE ' || s || ' 12' else '12 AV ' || s || ' APPT 3 RABAT' end, case k when 0 then 0.74 else 0.58 end::double, 1 from k where k in (0, 2)
union all select c_custkey, 'lieu_naissance', 'TANGER ' || s, 0.72, 1 from k where k = 1
union all select c_custkey, 'prenom', g, 0.82, 1 from k where k = 2 union all select c_custkey, 'nom', 'EL ' || s, 0.82, 1 from k where k = 2""")
def visible_identity(spark, sf_dir):
    """Cards with labels, with a number on each of two pages, flattened to one line, and without any field."""
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 6, "0")
    s, g = F.translate(n, DIGITS, SURNAME), F.translate(n, DIGITS, GIVEN)
    first = cases(k % 4, written("CNIE : AB", n, "\nAdresse : RUE ", s, " 12\nLieu de naissance : MAROC"), written("CIN XY99999\nNé à : ignored\nLIEU DE NAISSANCE ", F.lit("Tanger "), s, "\nAdresse : court"), written("n°AB", n, " 7 ", F.lower(g), " el ", F.lower(s), " née le 01.02.1990 12 av ", F.lower(s), " appt 3 rabat IDMAR<<"), F.lit("rien"))
    second = F.when(k % 4 == 1, written("CNIE: ab ", n)).otherwise("")
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(first, second)).alias("at", "text")).select("c_custkey", (F.col("at") + 1).alias("page"), "text")
    return identity.visible_identity(pages, "c_custkey", "page", "text").select("c_custkey", "field", "value", "confidence", "page")


def _slips(spark, sf_dir):
    """Lines of labelled cells: beside, above, in the cell, and twice."""
    o = table(spark, sf_dir, "orders")
    s, price = F.translate(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), DIGITS, SURNAME), money(F.floor("o_totalprice") / 100)
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    lines = [written("Employeur | ATELIER ", s, " SARL"), F.lit("Poste | Date d'embauche"), written("Technicien | ", day), written("NET A PAYER : ", price), written("Periode : ", F.date_format("o_orderdate", "MM/yyyy")), F.when(F.col("o_orderkey") % 2 == 0, written("Net à payer | ", price, " MAD")).otherwise("fin 1,00")]
    return o.select("o_orderkey", F.posexplode(F.array(*lines)).alias("line_no", "raw"))


SLIPS = f"s as (select o_orderkey, translate(lpad(o_custkey::varchar, 6, '0'), '{DIGITS}', '{SURNAME}') s, replace(replace(format('{{:,.2f}}', floor(o_totalprice) / 100), ',', ' '), '.', ',') price, strftime(o_orderdate, '%d/%m/%Y') as day, strftime(o_orderdate, '%m/%Y') as month from orders)"


@query(f"with {SLIPS} select o_orderkey, 'employeur' field, 'ATELIER ' || s || ' SARL' as value from s union all select o_orderkey, 'poste', 'Date d''embauche' from s union all select o_orderkey, 'net', case when o_orderkey % 2 = 0 then price || ' MAD' else price end from s union all select o_orderkey, 'embauche', day from s")
def label_value(spark, sf_dir):
    labels = {"employeur": "^employeur", "poste": "^poste", "net": "net a payer", "embauche": "^date d.embauche"}
    return identity.label_values(_slips(spark, sf_dir), "o_orderkey", "line_no", "raw", labels)


@query(f"with {SLIPS} select o_orderkey, 'net' field, price as value, 0.9::double confidence from s union all select o_orderkey, 'periode', month, 0.8::double from s")
def payslip_fields(spark, sf_dir):
    layouts = [("net", r"(?i)net\s+a\s+payer\s*:?\s*(\d[\d ]*,\d{2})", 0.9), ("net", r"(\d[\d ]*,\d{2})", 0.5), ("periode", r"(?i)periode\s*:\s*(\d{2}/\d{4})", 0.8)]
    return identity.payslip_fields(_slips(spark, sf_dir), "o_orderkey", "line_no", "raw", layouts)


#: Messages, the mode that each asks for, and whether it asks for documentation; every ninth comes within a guided conversation.
MESSAGES = (
    ("Je veux simuler un crédit de {}", "guidance", False), ("Bonjour !", "conversation", False), ("Quels documents pour {} dirhams ?", "rag", True), ("Comment estimer ma mensualité sur {} ?", "rag", True), ("le délai est long, {}", "rag", True), ("j'ai {} dirhams", "rag", False), ("Estimation, {}", "guidance", False),
)


def _message(key):
    x = F.floor("o_totalprice").cast("string")
    return cases(key % len(MESSAGES), *[written(*[p for part in zip(m.split("{}"), [x, x], strict=False) for p in part][: 2 * len(m.split("{}")) - 1]) for m, _, _ in MESSAGES])


def _listed(values) -> str:
    return "([" + ", ".join("'" + str(v) + "'" if isinstance(v, str) else str(v).lower() for v in values) + "])"


@query(f"select o_orderkey, case when o_orderkey % 9 = 0 then 'guidance' else {_listed([m for _, m, _ in MESSAGES])}[o_orderkey % 7 + 1] end mode, {_listed([d for _, _, d in MESSAGES])}[o_orderkey % 7 + 1] documentation from orders")
def chat_route(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.select("o_orderkey", _message(F.col("o_orderkey")).alias("message"), (F.col("o_orderkey") % 9 == 0).alias("guided"))
    return conversation.route(d, "message", F.col("guided")).select("o_orderkey", "mode", "documentation")


@query("""with o as (select o_orderkey, o_orderkey % 40 y, floor(o_totalprice) a, (o_orderkey % 250) / 10.0 r, o_orderkey % 7 <> 0 asked from orders),
v as (select *, asked and y between 5 and 30 and a > 0 and r between 0 and 20 ok from o) select o_orderkey, case when ok then y end::integer as \"years\", case when ok then a end::double amount, case when ok then r end::double rate from v""")
def chat_triple(spark, sf_dir):
    key, a = F.col("o_orderkey"), F.floor("o_totalprice")
    rate = F.format_string("%.1f", (key % 250) / 10)
    message = written((key % 40).cast("string"), " ans, ", a.cast("string"), ", ", F.when(key % 2 == 0, F.replace(rate, F.lit("."), F.lit(","))).otherwise(rate))
    previous = F.when(key % 7 != 0, "Indiquez la durée du prêt, le montant du financement et le taux d'intérêt.").otherwise("autre")
    d = table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"), previous.alias("previous"))
    return conversation.follow_up(d, "message", "previous").select("o_orderkey", "years", "amount", "rate")


@query("""select o_orderkey, 'revenu_mensuel_net' field, floor(o_totalprice)::double as value from orders where o_orderkey % 3 <> 2 union all select o_orderkey, 'apport_personnel', (o_orderkey % 900 + 1) * 1000.0 from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'prix_bien', null from orders where o_orderkey % 3 = 2""")
def chat_numbers(spark, sf_dir):
    key = F.col("o_orderkey")
    spaced = F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit(" "))
    message = cases(key % 3, written("mon salaire est ", spaced, " et un apport de ", (key % 900 + 1).cast("string"), " k"), written("Revenu net : ", spaced, ".\n"), written("le prix: 1.", (key % 900 + 100).cast("string"), ".000"))
    return conversation.money_slots(table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message")), "o_orderkey", "message")


@query("""with o as (select o_orderkey, o_orderkey % 6 k, floor(o_totalprice)::double x from orders)
select o_orderkey, case k when 0 then 'profession' when 1 then 'charges_mensuelles' when 2 then 'duree_souhaitee_annees' when 3 then 'secteur_activite' when 4 then 'prix_bien' end field, case k when 0 then 'Infirmier Libéral' when 3 then 'public ' || x::bigint end as "text", case k when 1 then x when 2 then 15.0 when 4 then 0.0 end number from o where k <> 5""")
def slot_updates(spark, sf_dir):
    """Messages with a profession, with an amount, with an answer to the slot that was asked for, with a text for it, with an amount that is none, and with nothing."""
    key, x = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    k = key % 6
    message = cases(k, F.lit("Je suis un infirmier libéral avec 3 enfants"), written("mes charges : ", x), F.lit("environ 15 ans"), written("  public ", x), F.lit("le prix 1.2.3 voila"), F.lit("x" * 81))
    asked = cases(k, F.lit("profession"), F.lit("charges_mensuelles"), F.lit("duree_souhaitee_annees"), F.lit("secteur_activite"), F.lit("prix_bien"), F.lit("statut_professionnel"))
    return conversation.slot_updates(table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"), asked.alias("asked")), "o_orderkey", "message", "asked")


PROFILES = """p as (select c_custkey, case when c_custkey % 2 = 0 then 'infirmier' end profession, case when c_custkey % 3 = 0 then 'cdi' end statut, case when c_custkey % 5 = 0 then 'public' end secteur, case when c_custkey % 7 <> 0 then c_custkey % 40 end::double anciennete from customer)"""


def _profiles(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, "infirmier").alias("profession"), F.when(k % 3 == 0, "cdi").alias("statut"), F.when(k % 5 == 0, "public").alias("secteur"), F.when(k % 7 != 0, (k % 40).cast("double")).alias("anciennete"))


@query(f"with {PROFILES}, m as (select c_custkey, list_filter([case when profession is null then 'profession' end, case when statut is null then 'statut' end, case when anciennete is null then 'anciennete' end], lambda x: x is not null) l from p) select c_custkey, l[1] as \"next\", array_to_string(l, '|') missing from m")
def profile_missing(spark, sf_dir):
    return conversation.missing_slots(_profiles(spark, sf_dir), "c_custkey", ("profession", "statut", "secteur", "anciennete"), ("secteur",))


@query(f"with {PROFILES} select c_custkey, case c_custkey % 4 when 1 then 'avocat' when 2 then repeat('z', 100) else profession end profession, case when c_custkey % 3 = 0 then 5.0 else anciennete end::double anciennete from p")
def profile_update(spark, sf_dir):
    """Updates with blank, valid and very long texts, negative and valid numbers; some customers have none."""
    k = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").where(k % 11 != 20).select("c_custkey", cases(k % 4, F.lit(" "), F.lit(" avocat "), F.lit("z" * 120), F.lit(None).cast("string")).alias("profession"), F.when(k % 3 == 0, 5.0).otherwise(-1.0).alias("anciennete"))
    return conversation.updated_profile(_profiles(spark, sf_dir), new, "c_custkey", ["profession", "anciennete"])
