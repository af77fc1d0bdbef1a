"""Queries on payslips. The driver's tables have none, so each order is written out as one, in one of several layouts, and read back; the SQL takes what it must say from the order itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.operators import payslips
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}
TODAY = "2026-06-01"
#: How digits and priorities are written as names, jobs and months.
DIGITS, SURNAME, GIVEN = "0123456789", "ABEGILMNOR", "ANIRUSTOLE"
JOBS = {"1-URGENT": "COMPTABLE", "2-HIGH": "INGENIEUR", "3-MEDIUM": "CAISSIER", "4-NOT SPECIFIED": "GERANT", "5-LOW": "TECHNICIEN"}
MONTHS = ("Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def money(c: Column) -> Column:
    """12345.6 as `12 345,60`."""
    return F.replace(F.replace(F.format_number(c, 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))


def written(*parts: str | Column) -> Column:
    """Text of columns and literals; a part that starts a line says so itself."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _people(spark, sf_dir):
    """Orders with the names, days and amounts that their payslips show; net is whole cents."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = lambda c, letters: F.translate(F.lpad(c.cast("string"), 6, "0"), DIGITS, letters)
    job = F.create_map(*[F.lit(x) for kv in JOBS.items() for x in kv])[F.col("o_orderpriority")]
    hired = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return o.select(
        "o_orderkey", (key % 5).alias("layout"), name(F.col("o_custkey"), SURNAME).alias("s"), name(key, GIVEN).alias("g"), F.coalesce(job, F.lit("GERANT")).alias("job"), F.date_format(hired, "dd/MM/yyyy").alias("hired"),
        F.date_format("o_orderdate", "MM").alias("mm"), F.date_format("o_orderdate", "yyyy").alias("yyyy"), (F.floor("o_totalprice") / 100 + 1).alias("net"),
    )


PEOPLE = f"""p as (select o_orderkey, o_orderkey % 5 layout, translate(lpad(o_custkey::varchar, 6, '0'), '{DIGITS}', '{SURNAME}') s, translate(lpad(o_orderkey::varchar, 6, '0'), '{DIGITS}', '{GIVEN}') g,
 case o_orderpriority {" ".join(f"when '{k}' then '{v}'" for k, v in JOBS.items())} else 'GERANT' end job, strftime(date '1990-01-01' + (o_custkey % 9000)::integer, '%d/%m/%Y') hired, strftime(o_orderdate, '%m') mm, strftime(o_orderdate, '%Y') yyyy, floor(o_totalprice) / 100 + 1 net from orders),
n as (select *, g[1] || lower(g[2:]) gt from p)"""


def _payslips(people):
    s, g, job, hired, mm, yyyy = (F.col(c) for c in ("s", "g", "job", "hired", "mm", "yyyy"))
    net, title = money(F.col("net")), F.initcap(F.lower("g"))
    month = F.get(F.array(*map(F.lit, MONTHS)), mm.cast("int") - 1)
    zero = written("[PAGE 1]\nATELIER ", s, " | BULLETIN DE PAIE\nNom et Prénom : ", s, " ", g, " | Adresse\nPériode de paie du 01/", mm, "/", yyyy, " au 28/", mm, "/", yyyy, "\n[PAGE 2]\nDate d'embauche | ", hired, "\nEmploi occupé : ", job, "\nNET A PAYER | ", net)
    one = written("[PAGE 1]\nRaison sociale | Fonction | Date d'entrée\nGARAGE ", s, " SARL | ", job, " | ", hired, "\nM | EL ", s, " ", g, " | RABAT\nN° 7 :\nBULLETIN DE PAIE | Période ", month, " ", yyyy, "\nNET A PAYER\n", net)
    two = written("[PAGE 1]\nATELIER ", s, " | BULLETIN DE PAIE\nMme ", s, " ", title, " | x\nHire date : ", hired, "\nJob title : ", job, "\nPay period : 01/", mm, "/", yyyy, "\nNet pay ", net, " MAD\nNet imposable 99 999,99 net a payer")
    three = written("[PAGE 1]\nService RH | ", yyyy, "\nSALAIRE BRUT | BRUT IMPOSABLE | TOTAL RETENUES | SALAIRE NET\n", money(F.col("net") + 250), " | ", money(F.col("net") + 100), " | 250,00 | ", net)
    text = F.when(F.col("layout") == 0, zero).when(F.col("layout") == 1, one).when(F.col("layout") == 2, two).when(F.col("layout") == 3, three).otherwise("[PAGE 1]\nPage illisible")
    return people.select("o_orderkey", "layout", "job", "yyyy", text.alias("text"))


@query(f"""with {PEOPLE},
f as (select o_orderkey, 'nom' field, case layout when 1 then 'EL ' || s else s end as value, case layout when 0 then 0.9 when 1 then 0.88 else 0.86 end confidence, case layout when 0 then 'replaced' else 'filled' end origin, 1 page from n where layout < 3
 union all select o_orderkey, 'prenom', gt, case layout when 0 then 0.9 when 1 then 0.88 else 0.86 end, case layout when 0 then 'replaced' else 'filled' end, 1 from n where layout < 3
 union all select o_orderkey, 'employeur', case layout when 1 then 'GARAGE ' || s || ' SARL' else 'ATELIER ' || s end, case layout when 1 then 0.86 else 0.72 end, 'filled', 1 from n where layout < 3
 union all select o_orderkey, 'periode', case layout when 0 then '01/' || mm || '/' || yyyy || ' au 28/' || mm || '/' || yyyy else mm || '/' || yyyy end, case layout when 0 then 0.92 when 1 then 0.88 else 0.84 end, 'replaced', 1 from n where layout < 3
 union all select o_orderkey, 'date_embauche', hired, 0.91, 'replaced', case layout when 0 then 2 else 1 end from n where layout < 3
 union all select o_orderkey, 'poste', job, case layout when 3 then 0.8 else 0.84 end, case layout when 3 then 'kept' else 'replaced' end, case layout when 0 then 2 else 1 end from n where layout < 4
 union all select o_orderkey, 'salaire_net', printf('%.2f', net), 0.93, 'replaced', case layout when 0 then 2 else 1 end from n where layout < 4)
select o_orderkey, field, value, confidence::double confidence, page, origin from f""")
def payslip_extraction(spark, sf_dir):
    """All seven fields; of the fourth layout a model gave the job, with proof."""
    slips = _payslips(_people(spark, sf_dir))
    given = slips.where("layout = 3").select("o_orderkey", F.lit("poste").alias("field"), F.col("job").alias("value"), F.lit(0.8).alias("confidence"), F.lit(1).alias("page"), F.concat(F.lit("Service RH | "), "yyyy").alias("quote"))
    out = payslips.payslip_values(slips.select("o_orderkey", "text"), given, "o_orderkey", "text", TODAY)
    value = F.when(F.col("field") == "salaire_net", F.format_string("%.2f", F.col("value").cast("double"))).otherwise(F.col("value"))
    return out.select("o_orderkey", "field", value.alias("value"), "confidence", "page", "origin")


@query("""with b as (select o_orderkey, o_orderkey % 4 layout, floor(o_totalprice) / 100 net from orders)
select o_orderkey, case layout when 0 then net + 350 when 1 then net + 250 when 2 then 1516.70 + 100 - 50.30 + net end salaire_brut, case layout when 0 then net + 300 when 1 then net + 900 end brut_imposable,
case layout when 0 then 350 when 1 then 250 when 3 then 150.25 end::double total_retenues, case when layout < 2 then net end salaire_net, case layout when 2 then 1516.70 end::double salaire_base from b""")
def payslip_totals(spark, sf_dir):
    """Totals by their labels, in a block (gross second, so that the identity settles it), lost gross with its rows, and withholdings in two parts."""
    net = F.col("net")
    b = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("layout"), (F.floor("o_totalprice") / 100).alias("net"))
    zero = written("TOTAL BRUT : ", money(net + 350), "\nBRUT IMPOSABLE | ", money(net + 300), "\nTOTAL DES RETENUES 350,00\nNET À PAYER ", money(net))
    one = written("SALAIRE BRUT BRUT IMPOSABLE TOTAL RETENUES SALAIRE NET ", money(net + 900), " | ", money(net + 250), " | 250,00 | ", money(net))
    two = written("Salaire de Base 151,67 10,00 1 516,70\nPrime d'Ancienneté 100,00\nMajoration -50,30\nCplt ", money(net), "\nSALAIRE BRUT MENS\n")
    three = F.lit("Total des retenues déductibles : 100,00 Total des retenues non déductibles : 50,25")
    text = F.when(F.col("layout") == 0, zero).when(F.col("layout") == 1, one).when(F.col("layout") == 2, two).otherwise(three)
    out = payslips.pay_totals(b.select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    return out.select("o_orderkey", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


@query("""with t as (select l_orderkey, round(sum(floor(l_extendedprice)), 0) g, list(floor(l_extendedprice) order by l_linenumber, l_partkey, l_suppkey) parts from lineitem group by 1),
c as (select l_orderkey, [g, g + 40, g - 40] gross, parts withheld, [g - parts[1] + 1, g - parts[len(parts)]] net from t),
x as (select l_orderkey, a.g, a.i, b.r, b.j, d.n, d.k from c, unnest(list_transform(gross, lambda v, i: {'g': v, 'i': i})) as a1(a), unnest(list_transform(withheld, lambda v, i: {'r': v, 'j': i})) as b1(b), unnest(list_transform(net, lambda v, i: {'n': v, 'k': i})) as d1(d)),
y as (select *, row_number() over (partition by l_orderkey order by abs(g - r - n), i, j, k) rn from x)
select l_orderkey, abs(g - r - n) distance, g gross, r withheld, n net from y where rn = 1""")
def accounting_identity(spark, sf_dir):
    """Of gross, withheld and net candidates of an order, those that fit best."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice").cast("double").alias("v")))), lambda x: x["v"])  # an order's lines
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.floor("l_extendedprice").cast("double")), 0).alias("g"), parts.alias("parts"))
    best = payslips.nearest_identity(F.array(F.col("g"), F.col("g") + 40, F.col("g") - 40), F.col("parts"), F.array(F.col("g") - F.get("parts", F.lit(0)) + 1, F.col("g") - F.element_at("parts", -1)))
    return t.select("l_orderkey", best.alias("b")).select("l_orderkey", "b.*")


@query(f"""with {PEOPLE}, v as (select *, o_orderkey % 6 k from n)
select o_orderkey, case k when 0 then s when 1 then s when 2 then s when 3 then 'EL ' || s when 4 then null else s || ' X' end nom, case k when 2 then gt when 4 then null when 5 then g else lower(g) end prenom, case k when 0 then 0.88 when 1 then 0.86 when 2 then 0.68 when 3 then 0.86 end::double confidence from v""")
def name_parts(spark, sf_dir):
    """Two fields and the name after a title: the surname doubled, missing, both missing, a wrong surname, nothing, and nothing in common."""
    p = _people(spark, sf_dir).withColumn("k", F.col("o_orderkey") % 6)
    s, g, k = F.col("s"), F.col("g"), F.col("k")
    nom = F.when(k == 0, F.concat(F.lower(s), F.lit(" "), g)).when(k == 3, "WRONG").when(k == 5, F.concat(s, F.lit(" X")))
    prenom = F.when(k.isin(0, 1, 3), F.lower(g)).when(k == 5, g)
    identity = F.when(k.isin(0, 1, 2), F.concat(s, F.lit(" "), g)).when(k == 3, F.concat(F.lit("EL "), s, F.lit(" "), g)).when(k == 5, F.concat(s, F.lit(" "), s))
    out = payslips.reconciled_names(nom, prenom, identity)
    return p.select("o_orderkey", out[0].alias("nom"), out[1].alias("prenom"), out[2].alias("confidence"))


@query("""with d as (select o_orderkey, o_orderkey % 6 k, o_orderdate::date + ((o_orderkey % 5) * 9000)::integer as day from orders)
select o_orderkey, case when k in (4, 5) then false else day <= date '2026-06-01' end hired, k = 3 or (k in (1, 2) and year(day) < 2100) period from d""")
def payslip_checks(spark, sf_dir):
    """Whether texts are a day of employment, and a pay period."""
    k = F.col("o_orderkey") % 6
    day = F.date_add(F.col("o_orderdate").cast("date"), ((F.col("o_orderkey") % 5) * 9000).cast("int"))
    shape = lambda f: F.date_format(day, f)
    text = F.when(k == 0, shape("dd/MM/yyyy")).when(k == 1, shape(" d-M-yyyy ")).when(k == 2, shape("dd.MM.yyyy")).when(k == 3, shape("yyyy-MM-dd")).when(k == 4, shape("dd/13/yyyy")).otherwise("x")
    period = F.when(k == 1, shape("M / yyyy")).when(k == 2, F.concat(F.lit("Août  "), shape("yyyy"))).when(k == 3, F.concat(shape("dd/MM/yyyy"), F.lit(" au "), shape("d-M-yy"))).when(k == 4, shape("13/yyyy")).when(k == 5, F.concat(F.lit("Brumaire "), shape("yyyy")))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", payslips.valid_employment_date(text, F.lit(TODAY).cast("date")).alias("hired"), payslips.valid_pay_period(period).alias("period"))
