"""Queries on typed values, confirmations, evidence and layout. Their inputs are written out from rows of the driver's tables in the shapes that documents use; the SQL takes the results from the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers
from ledgerloom.functions import text as T
from ledgerloom.operators import confirmation, layout, statements
from ledgerloom.plans.payslips import money, written
from ledgerloom.plans.statements import _lines
from ledgerloom.plans.statements import OPERATIONS, statements as written_statements
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}
TODAY = "2026-01-01"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def cases(at: Column, *values) -> Column:
    """The value with the number `at`, from 0."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(at == i, v) if i == 0 else out.when(at == i, v)
    return out


def _orders(spark, sf_dir, kinds: int):
    o = table(spark, sf_dir, "orders")
    return o.withColumns({"k": F.col("o_orderkey") % kinds, "x": F.floor("o_totalprice") / 100 + 1000, "d": F.col("o_orderdate").cast("date")})


def orders(kinds: int) -> str:
    return f"o as (select *, o_orderkey % {kinds} k, floor(o_totalprice) / 100 + 1000 x, o_orderdate::date d from orders)"


@query(f"with {orders(7)} select o_orderkey, case when k = 4 then null when k = 5 then -x when k = 6 then x * 100 else x end strict, case k when 1 then null when 2 then null when 4 then null when 5 then -x when 6 then x * 100 else x end loose from o")
def amount_parse(spark, sf_dir):
    """Amounts in seven shapes: with a currency, with points or commas between thousands, plain, none, negative, in whole hundredths."""
    o = _orders(spark, sf_dir, 7)
    x = F.col("x")
    spaced, english = money(x), F.format_number(x, 2)
    plain = F.replace(spaced, F.lit(" "), F.lit(""))
    raw = cases(F.col("k"), F.concat(spaced, F.lit(" MAD")), F.replace(spaced, F.lit(" "), F.lit(".")), english, plain, F.lit("abc"), F.concat(F.lit("-"), plain, F.lit(" DH")), F.round(x * 100).cast("long").cast("string"))
    return o.select("o_orderkey", numbers.strict_amount(raw).alias("strict"), numbers.loose_amount(raw).alias("loose"))


@query(f"with {orders(5)} select o_orderkey, case when k < 3 then strftime(d, '%Y-%m-%d') end as day from o")
def date_parse(spark, sf_dir):
    o, d = _orders(spark, sf_dir, 5), F.col("d")
    raw = cases(F.col("k"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd-MM-yyyy"), F.date_format(d, "31/02/yyyy"), F.date_format(d, "d/M/yy"))
    return o.select("o_orderkey", F.date_format(dates.parse_date(raw), "yyyy-MM-dd").alias("day"))


@query(f"""with {orders(8)} select o_orderkey, case k when 5 then null when 6 then '2031-' || strftime(d, '%m-%d') when 7 then null else strftime(d, '%Y-%m-%d') end loose, case k when 5 then null when 6 then case when month(d) = 1 then '2032-' else '2031-' end || strftime(d, '%m-%d') when 2 then null else strftime(d, '%Y-%m-%d') end statement,
case when k in (0, 1, 2, 3, 4) then strftime(d, '%d/%m/%Y') when k = 7 then strftime(d, '%d/%m/%Y') end display from o where not (k = 6 and month(d) = 2 and day(d) = 29)""")
def date_shapes(spark, sf_dir):
    """Dates with slashes, short years, blanks, points, hyphens, none, a day and month alone (year 2031, after an opening balance of December), and with two kinds of marks."""
    o, d = _orders(spark, sf_dir, 8).where("not (k = 6 and month(d) = 2 and day(d) = 29)"), F.col("d")
    shape = lambda f: F.date_format(d, f)
    short = F.when(F.year(d) < 2000, shape("dd/MM/yyyy")).otherwise(shape("d/M/yy"))
    raw = cases(F.col("k"), shape("dd/MM/yyyy"), short, shape(" d MM  yyyy "), shape("dd.MM.yyyy"), shape("d-M-yyyy"), F.lit("n/a"), shape("d/M"), shape("dd/MM - yyyy"))
    year, month = F.lit(2031), F.lit(12)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("o_orderkey", iso(dates.loose_date(raw, year)).alias("loose"), iso(dates.statement_date(raw, year, month)).alias("statement"), dates.display_date(raw).alias("display"))


@query(f"with {OPERATIONS}, y as (select doc, year(day) y, count(*) n from ops where not (proven and o % 2 = 1) group by all) select doc, case when proven then year(first) else (select arg_max(y, n) from y where y.doc = doc.doc) end::integer as \"year\", case when proven then month(first) end::integer as \"month\" from doc")
def statement_anchor(spark, sf_dir):
    docs, _ = written_statements(spark, sf_dir)
    year, month = dates.statement_anchor(F.col("text"))
    return docs.select("doc", year.alias("year"), month.alias("month"))


@query("""with c as (select c_custkey, case c_custkey % 5 when 0 then '  Client' || c_custkey || '@Example.COM ' when 1 then 'no-at' || c_custkey when 2 then 'a' || c_custkey || '@b' when 3 then 'x y' || c_custkey || '@example.org' else 'N' || c_custkey || '@x.y.z' end raw from customer)
select c_custkey, lower(trim(raw)) email, c_custkey % 5 in (0, 4) valid from c""")
def email_valid(spark, sf_dir):
    k = F.col("c_custkey")
    raw = cases(k % 5, written("  Client", k, "@Example.COM "), written("no-at", k), written("a", k, "@b"), written("x y", k, "@example.org"), written("N", k, "@x.y.z"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normal_email(raw).alias("email"), T.valid_email(raw).alias("valid"))


@query("""with o as (select o_orderkey, (['=', ' +', '-', '@', '', 'a=', '  '])[o_orderkey % 7 + 1] || o_orderpriority raw from orders) select o_orderkey, case when regexp_matches(ltrim(raw), '^[-=+@]') then '''' || raw else raw end cell from o""")
def csv_escape(spark, sf_dir):
    raw = F.concat(cases(F.col("o_orderkey") % 7, *map(F.lit, ("=", " +", "-", "@", "", "a=", "  "))), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.csv_cell(raw).alias("cell"))


@query(f"with {OPERATIONS} select distinct doc, shown date_text, amount from ops where kind = 3")
def keyword_transactions(spark, sf_dir):
    docs, _ = written_statements(spark, sf_dir)
    return statements.keyword_transactions(_lines(docs), "doc", "raw", "prelevement|echeance").select("doc", "date_text", "amount")


@query("select c_custkey, case when c_custkey % 2 = 0 then 0.875 else 16.0 / (16 + c_custkey % 5) end::double ratio from customer")
def fuzzy_match(spark, sf_dir):
    """A word with one letter replaced, or with up to four letters too many, against targets of which one is its own."""
    k = F.col("c_custkey")
    at = (k / 2).cast("long") % 8
    word = F.when(k % 2 == 0, F.concat(F.expr("substring('virement', 1, cast(c_custkey / 2 as bigint) % 8)"), F.lit("x"), F.expr("substring('virement', cast(c_custkey / 2 as bigint) % 8 + 2, 8)"))).otherwise(F.concat(F.lit("virement"), F.expr("repeat('z', cast(c_custkey % 5 as int))")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", word.alias("word"), F.lit("virement|qqqq").alias("targets"), at.alias("at"))
    return rows.select("c_custkey", statements.best_likeness("word", "targets").alias("ratio"))


def _series(spark, sf_dir):
    """Evidence of each order in a first reading, and in a second one with the same quote, with a longer description, or with another amount."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    base = o.select(
        F.col("o_custkey").cast("string").alias("doc"), F.lit(0).alias("priority"), key.cast("int").alias("pos"), (key % 2 + 1).cast("int").alias("page"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"),
        F.floor("o_totalprice").cast("double").alias("amount"), written("virement ", F.lpad(key.cast("string"), 7, "0")).alias("description"), written("q  ", key).alias("quote"),
    )
    kind = F.col("pos") % 3
    more = base.withColumns({"priority": F.lit(1), "quote": F.when(kind == 0, F.upper(F.replace("quote", F.lit("  "), F.lit(" ")))).otherwise(F.concat(F.lit("other "), "pos")), "description": F.concat(F.lit("VIREMENT de "), "description"), "amount": F.when(kind == 2, F.col("amount") + 1).otherwise(F.col("amount"))})
    return base.unionByName(more)


@query("select o_custkey::varchar doc, priority, o_orderkey::integer pos from orders, (values (0), (1)) v(priority) where priority = 0 or o_orderkey % 3 = 2")
def merge_evidence(spark, sf_dir):
    return statements.merge_evidence(_series(spark, sf_dir), "doc").select("doc", "priority", "pos")


@query("""with e as (select o_custkey::varchar doc, o_orderkey % 2 + 1 page, strftime(o_orderdate, '%d/%m/%Y') as date, floor(o_totalprice) + p amount, case when p = 1 then 'virement de ' else '' end || 'virement ' || lpad(o_orderkey::varchar, 7, '0') as description, case when p = 1 then 'other ' else 'q ' end || o_orderkey as quote from orders, (values (0), (1)) v(p) where p = 0 or o_orderkey % 3 = 2)
select doc, date, amount, substring(sha256(concat_ws('|', page::varchar, date, printf('%.2f', amount), description, quote)), 1, 16) candidate_id from e""")
def credit_candidates(spark, sf_dir):
    return statements.credit_candidates(statements.merge_evidence(_series(spark, sf_dir), "doc"), "doc").select("doc", "date", "amount", "candidate_id")


#: Records of customers by type; which of their fields are right depends on the customer's number.
RECORDS = """c as (select c_custkey, c_custkey % 4 k, c_custkey % 3 bad, abs(c_acctbal) bal from customer),
r as (select c_custkey, 'cin_format' rule, bad <> 1 passed from c where k = 0 union all select c_custkey, 'nom_present', true from c where k = 0 union all select c_custkey, 'prenom_present', bad <> 2 from c where k = 0 union all select c_custkey, 'date_naissance', bad <> 1 from c where k = 0
 union all select c_custkey, 'date_embauche', bad <> 1 from c where k = 1 union all select c_custkey, 'salaire_brut_positif', true from c where k = 1 union all select c_custkey, 'salaire_net_positif', bad <> 2 from c where k = 1 union all select c_custkey, 'net_inferieur_brut', bad <> 0 from c where k = 1
 union all select c_custkey, 'charge_mensuelle_credits', bad <> 1 from c where k = 2
 union all select c_custkey, 'acheteur_present', bad <> 0 from c where k = 3 union all select c_custkey, 'vendeur_present', true from c where k = 3 union all select c_custkey, 'prix_vente_positif', bad <> 1 from c where k = 3 union all select c_custkey, 'date_signature', bad <> 2 from c where k = 3)"""


@query(f"with {RECORDS} select * from r")
def document_rules(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"k": F.col("c_custkey") % 4, "bad": F.col("c_custkey") % 3, "bal": F.abs("c_acctbal")})
    wrong = lambda n, yes, no: F.when(F.col("bad") == n, yes).otherwise(no)
    fields = lambda **named: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in named.items() for x in kv])
    bal = F.format_string("%.2f", "bal")
    cards = fields(cin=wrong(1, "1AB", "ab12345"), nom="TAZI", prenom=wrong(2, "  ", "ANA"), date_naissance=wrong(1, "31/02/1990", "01/02/1990"))
    slips = fields(date_embauche=wrong(1, "01/02/2030", "01/02/2020"), salaire_brut=bal, salaire_net=F.when(F.col("bad") == 2, F.lit("-1")).when(F.col("bad") == 0, F.format_string("%.2f", F.col("bal") + 1)).otherwise(bal))
    deeds = fields(acheteur_nom=wrong(0, "", "X"), vendeur_nom="Y", prix_vente=wrong(1, "NaN", "1000"), date_signature=wrong(2, "x", "2024-01-31"))
    loans = fields(charge_mensuelle_credits=wrong(1, "-5", "12.5"))
    rows = c.select("c_custkey", cases(F.col("k"), *map(F.lit, ("carte_identite", "bulletin", "releve", "compromis"))).alias("kind"), cases(F.col("k"), cards, slips, loans, deeds).alias("fields"))
    return confirmation.document_rules(rows, "c_custkey", "kind", "fields", TODAY)


TYPED = f"""{orders(8)},
t as (select o_orderkey, o_custkey, k, case k when 0 then x::varchar when 1 then x::varchar when 4 then strftime(d, '%Y-%m-%d') end as value, case k when 2 then 'required' when 3 then 'amount' when 5 then 'date' when 6 then 'future' end error, case k when 0 then 'corrige' when 1 then 'confirme' when 4 then 'corrige' when 7 then 'confirme' end status from o)"""


def _typed(spark, sf_dir):
    o, x, d = _orders(spark, sf_dir, 8), F.col("x"), F.col("d")
    amount = F.replace(F.format_string("%.2f", x), F.lit("."), F.lit(","))
    kind = cases(F.col("k"), *map(F.lit, ("bulletin", "bulletin", "bulletin", "bulletin", "carte_identite", "carte_identite", "carte_identite", "compromis")))
    field = cases(F.col("k"), *map(F.lit, ("salaire_net", "salaire_net", "salaire_net", "salaire_net", "date_naissance", "date_naissance", "date_naissance", "devise")))
    raw = cases(F.col("k"), money(x), amount, F.lit(" "), F.concat(F.lit("-"), amount), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "31/02/yyyy"), F.lit("2999-01-01"), F.lit(""))
    original = cases(F.col("k"), F.lit("6000"), F.format_string("%.2f", x), F.lit("1"), F.lit("1"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = o.select("o_orderkey", "o_custkey", kind.alias("kind"), field.alias("field"), raw.alias("raw"), original.alias("original"))
    return confirmation.confirmed_values(rows, "kind", "field", "raw", "original", TODAY)


@query(f"with {TYPED} select o_orderkey, case when k < 2 then printf('%.2f', value::double) else value end as value, error, status from t")
def confirmed_field_values(spark, sf_dir):
    shown = F.when(F.col("o_orderkey") % 8 < 2, F.format_string("%.2f", F.col("value").cast("double"))).otherwise(F.col("value"))
    return _typed(spark, sf_dir).select("o_orderkey", shown.alias("value"), "error", "status")


@query(f"with {TYPED} select o_orderkey, o_orderkey // 2 form, status from t where o_orderkey // 2 not in (select o_orderkey // 2 from t where error is not null)")
def review_submission(spark, sf_dir):
    """The typed values of forms (two orders each) none of whose values has an error."""
    typed = _typed(spark, sf_dir).withColumn("form", F.floor(F.col("o_orderkey") / 2))
    return confirmation.all_or_nothing(typed, "form").select("o_orderkey", "form", "status")


@query("select l_orderkey, count(*) n, count(*) filter (l_returnflag <> 'R' and l_linenumber % 2 = 1 and l_suppkey % 3 <> 0 and l_partkey % 4 <> 0 and l_suppkey % 10 <> 1) valid from lineitem group by 1")
def valid_confirmations(spark, sf_dir):
    """How many records of an order count: of its own document, confirmed or corrected, checked, with an advisor and a value."""
    ok = confirmation.valid_confirmation(
        F.col("l_orderkey"), F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.col("l_orderkey")), F.when(F.col("l_linenumber") % 2 == 1, "corrige").otherwise("brouillon"), F.col("l_suppkey") % 3 != 0,
        F.when(F.col("l_partkey") % 4 != 0, "ana").otherwise(""), F.lit("2024-01-01"), F.when(F.col("l_suppkey") % 10 != 1, F.col("l_quantity")),
    )
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


@query("""with s as (select o_custkey, max(o_orderkey) last, count(*) n from orders where o_orderstatus = 'O' group by 1) select o_custkey, 'income' field, 'second ' || n as value from s""")
def dossier_override(spark, sf_dir):
    """Three records of a customer: the present open orders in the order of keys, the same later in another order, and latest a set that lacks one."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").cast("string").alias("source_id"))
    ids = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("source_id")).alias("ids"), F.count("*").alias("n"))  # a customer's orders
    record = lambda name, at, of: F.struct(F.concat(F.lit(f"{name} "), "n").alias("value"), F.lit(at).alias("confirmed_at"), of.alias("source_ids"))
    three = F.array(record("first", "2024-01-01", F.col("ids")), record("second", "2024-01-02", F.concat(F.reverse("ids"), F.slice("ids", 1, 1))), record("third", "2024-01-03", F.slice("ids", F.lit(2), F.size("ids"))))
    records = ids.select("o_custkey", F.explode(three).alias("r")).select("o_custkey", F.lit("income").alias("field"), "r.*")
    return confirmation.dossier_override(records, o, "o_custkey", "field")


@query(f"with {orders(4)} select o_orderkey, case k when 0 then 'number:' || printf('%.2f', x) when 1 then 'text:ete ' || o_orderkey when 2 then 'date:' || strftime(d, '%Y-%m-%d') else 'text:ete bleu ' || o_orderkey end canonical from o")
def canonical_values(spark, sf_dir):
    o = _orders(spark, sf_dir, 4)
    raw = cases(F.col("k"), money(F.col("x")), written("Été ", F.col("o_orderkey")), F.date_format("d", "dd/MM/yyyy"), written(" Été  Bleu ", F.col("o_orderkey")))
    kind = cases(F.col("k"), *map(F.lit, ("number", "number", "date", "text")))
    return o.select("o_orderkey", confirmation.canonical(raw, kind).alias("canonical"))


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) rn, replace(replace(format('{:,.2f}', floor(o_totalprice) / 100), ',', ' '), '.', ',') a from orders)
select o_custkey::varchar page, 0 as "row", 'DEBIT | CREDIT' line from r where rn = 1 union all select o_custkey::varchar, rn::integer, o_orderkey || ' | ' || case o_orderkey % 3 when 0 then 'DEBIT: ' || a when 1 then 'CREDIT: ' || a else 'note' end from r""")
def layout_rows(spark, sf_dir):
    """A customer's orders as a table of tokens: key, and an amount under the debit or the credit heading or a note."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("page"), "o_orderkey", rn.alias("rn"), money(F.floor("o_totalprice") / 100).alias("a"))
    token = lambda text, x0, x1, y: F.struct(text.alias("text"), F.lit(float(x0)).alias("x0"), y.cast("double").alias("y0"), F.lit(float(x1)).alias("x1"), (y + 10).cast("double").alias("y1"))
    y, kind = F.col("rn") * 16 + F.col("o_orderkey") % 3, F.col("o_orderkey") % 3
    body = F.array(token(F.col("o_orderkey").cast("string"), 10, 60, y), F.when(kind == 0, token(F.col("a"), 610, 680, y + 1)).when(kind == 1, token(F.col("a"), 730, 800, y + 1)).otherwise(token(F.lit("note"), 100, 300, y - 1)))
    heads = F.array(token(F.lit("DEBIT"), 600, 680, F.lit(0)), token(F.lit("CREDIT"), 720, 810, F.lit(0)))
    return layout.layout_rows(o.select("page", F.explode(F.when(F.col("rn") == 1, F.concat(heads, body)).otherwise(body)).alias("t")).select("page", "t.*"), "page")


@query("select o_custkey::varchar page, o_orderkey::varchar as text from orders union all select o_custkey::varchar, 'b' || o_orderkey from orders where o_orderkey % 3 = 2")
def box_dedupe(spark, sf_dir):
    """A box for each order, and a second reading less sure: of the same place, of a part of it, or beside it."""
    key = F.col("o_orderkey")
    box = lambda text, sure, x0, x1: F.struct(text.alias("text"), F.lit(sure).alias("confidence"), x0.cast("double").alias("x0"), F.lit(0.0).alias("y0"), x1.cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    left = key * 40
    second = F.when(key % 3 == 0, box(F.concat(F.lit("b"), key), 0.6, left + 1, left + 11)).when(key % 3 == 1, box(F.concat(F.lit("b"), key), 0.6, left + 2, left + 5)).otherwise(box(F.concat(F.lit("b"), key), 0.6, left + 5, left + 25))
    boxes = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("page"), F.explode(F.array(box(key.cast("string"), 0.9, left, left + 10), second)).alias("b")).select("page", "b.*")
    return layout.box_dedupe(boxes, "page").select("page", "text")
