"""Queries on dossiers, exports, audit events and readings. Documents and decisions are written out from orders and customers; the SQL takes the results from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import dossiers as ops
from ledgerloom.operators.texts import text_rows
from ledgerloom.plans.fields import cases
from ledgerloom.plans.payslips import written
from ledgerloom.plans.statements import OPERATIONS
from ledgerloom.plans.statements import statements as written_statements
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}
SPECS = [("employeur", "bulletin", "text"), ("revenus_complementaires", "releve", "number"), ("charge_mensuelle_credits", "releve", "number"), ("prix_vente", "compromis", "number")]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: An order is a document: its type, state, file and values follow from its key. Two of three proposals are confirmed ones.
DOCUMENTS = """d as (select o_custkey cust, o_orderkey doc, (['bulletin', 'releve', 'compromis'])[o_orderkey % 3 + 1] kind, o_orderkey % 5 <> 0 done, o_orderdate tm, 'file' || o_orderkey % 4 filename, o_orderkey % 7 <> 0 decided, o_orderkey % 11 <> 0 readable, o_orderkey % 2 = 0 ok from orders),
s as (select * from (values ('employeur', 'bulletin'), ('revenus_complementaires', 'releve'), ('charge_mensuelle_credits', 'releve'), ('prix_vente', 'compromis')) t(field, kind)),
v as (select d.*, s.field, case when s.field = 'employeur' then 'ATELIER ' || doc % 3 else (doc % 9 * 50 + 1000)::varchar end x from d join s using (kind)),
w as (select *, row_number() over (partition by cust, field order by tm desc, doc) rn from v where done),
g as (select cust, field, list(x order by rn) filter (ok and decided) c, list(filename order by rn) filter (ok and decided) cf, list(x order by rn) filter (decided and readable) u, list(filename order by rn) filter (decided and readable) uf, list(filename order by rn) filter (decided) df, list(filename order by rn) af from w group by all),
q as (select k.cust, s.field, c, cf, u, uf, df, af, list_sort(list_transform(c, lambda z: try_cast(z as double))) n from (select distinct cust from d) k cross join s left join g on g.cust = k.cust and g.field = s.field),
r as (select *, field in ('revenus_complementaires', 'charge_mensuelle_credits') and len(c) > 0 money, n[case when field = 'revenus_complementaires' then (len(n) - 1) // 2 + 1 else len(n) // 2 + 1 end] mid, list_reduce(cf, lambda a, b: a) one from q)"""


def _documents(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    documents = o.select(F.col("o_custkey").alias("cust"), key.alias("doc_id"), cases(key % 3, *map(F.lit, ("bulletin", "releve", "compromis"))).alias("type"), F.when(key % 5 != 0, "completed").otherwise("failed").alias("status"), F.col("o_orderdate").alias("at"), written("file", key % 4).alias("filename"))
    fields = cases(key % 3, F.array(F.lit("employeur")), F.array(F.lit("revenus_complementaires"), F.lit("charge_mensuelle_credits")), F.array(F.lit("prix_vente")))
    rows = o.where(key % 7 != 0).select(F.col("o_custkey").alias("cust"), key.alias("doc_id"), F.explode(fields).alias("field"))
    x = F.when(F.col("field") == "employeur", written("ATELIER ", F.col("doc_id") % 3)).otherwise((F.col("doc_id") % 9 * 50 + 1000).cast("string"))
    return documents, rows.select("cust", "doc_id", "field", F.when(F.col("doc_id") % 11 != 0, x).alias("extracted"), F.when(F.col("doc_id") % 2 == 0, x).alias("confirmed"), F.date_format(F.timestamp_seconds(F.col("doc_id") * 7919 % 10**9), "yyyy-MM-dd HH:mm:ss").alias("confirmed_at"))


def _distinct(names: str) -> str:
    """SQL for the distinct names of a list in their first order, joined."""
    return f"array_to_string(list_filter({names}, lambda z, i: list_position({names}, z) = i), ', ')"


@query(f"""with {DOCUMENTS} select cust, field, case when money then (round(mid, 2))::double::varchar when len(c) > 0 then c[1] when len(u) > 0 then u[1] else '' end as value,
case when af is null then 'Document manquant' when money then case when len(n) = 1 then 'Estimation sur 1 relevé' when n[1] = n[-1] then 'Stable sur ' || len(n) || ' relevés' when (n[-1] - n[1]) / greatest(abs(mid), 1) <= 0.20 then 'Régulier sur ' || len(n) || ' relevés' else 'Variable sur ' || len(n) || ' relevés — à confirmer' end
 when len(c) > 0 then case when len(list_distinct(c)) > 1 then 'Conflit' else 'Déjà confirmé' end when len(u) > 0 then case when len(list_distinct(u)) > 1 then 'Conflit' else 'À vérifier' end else 'À compléter' end status,
case when af is null then '—' when len(c) > 0 then {_distinct('cf')} when len(u) > 0 then {_distinct('uf')} when len(df) > 0 then df[1] else af[1] end source from r""")
def dossier_proposals(spark, sf_dir):
    documents, values = _documents(spark, sf_dir)
    return ops.field_proposals(documents, values, SPECS, "cust")


@query("""with c as (select o_custkey cust, (o_orderkey % 9 * 50 + 1000)::varchar x, strftime(to_timestamp((o_orderkey * 7919) % 1000000000) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') tm, o_orderkey doc from orders where o_orderkey % 3 = 2 and o_orderkey % 2 = 0 and o_orderkey % 7 <> 0) select cust, arg_max(x, (tm, doc)) as value from c group by 1""")
def confirmed_price(spark, sf_dir):
    documents, values = _documents(spark, sf_dir)
    return ops.confirmed_document_value(documents, values, "cust", "compromis", "prix_vente")


@query("""select cust, field, done and conf complete from (select cust, field, bool_or(o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 2 = 0) conf, true done from (select o_custkey cust, o_orderkey, unnest(case o_orderkey % 3 when 0 then ['employeur'] when 1 then ['revenus_complementaires', 'charge_mensuelle_credits'] else ['prix_vente'] end) field from orders) group by 1, 2) where conf is not null""")
def field_completeness(spark, sf_dir):
    """Whether each field that a dossier has documents for is confirmed in one of them."""
    documents, values = _documents(spark, sf_dir)
    specs = F.create_map(*[F.lit(x) for f, t, _ in SPECS for x in (f, t)])
    every = documents.select("cust", F.explode(F.map_keys(F.map_filter(specs, lambda f, t: t == F.col("type")))).alias("field")).distinct()
    confirmed = values.where("confirmed is not null").join(documents.where("status = 'completed'").select("cust", "doc_id"), ["cust", "doc_id"]).select("cust", "field", F.lit(True).alias("complete")).distinct()
    return every.join(confirmed, ["cust", "field"], "left").select("cust", "field", F.coalesce("complete", F.lit(False)).alias("complete"))


@query("""select o_orderkey "Document ID", 'bulletin' "Type document", 'employeur' "Champ", case when o_orderkey % 3 = 0 then '''=cmd' else 'ATELIER' end "Valeur finale", case when o_orderkey % 2 = 0 then 'confirme' else 'corrige' end "Statut humain", null::varchar "Valeur extraite initiale", 'ana' "Utilisateur", strftime(o_orderdate, '%Y-%m-%d') "Confirmation UTC",
'f.pdf' "Document source", sha256(o_orderkey::varchar) "SHA256", 1 "Page", '''-x' "Extrait", o_orderkey % 4 = 1 "Citation retrouvee" from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0""")
def export_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        key.alias("document_id"), F.when(key % 5 != 0, key).otherwise(-key).alias("record_document"), F.lit("bulletin").alias("document_type"), F.lit("employeur").alias("field"), F.when(key % 3 == 0, "=cmd").otherwise("ATELIER").alias("value"), F.when(key % 2 == 0, "confirme").otherwise("corrige").alias("status"),
        (key % 7 != 0).alias("source_checked"), F.lit(None).cast("string").alias("original_value"), F.when(key % 11 != 0, "ana").otherwise("").alias("advisor_id"), F.when(key % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("confirmed_at"), F.lit("f.pdf").alias("source_document"),
        F.sha2(key.cast("string"), 256).alias("sha256"), F.lit(1).alias("page"), F.lit("-x").alias("quote"), F.when(key % 4 != 3, key % 4 == 1).alias("verified"),
    )
    return ops.confirmed_rows(o)


@query("""with e as (select event_id, event_type t, user_id, value from events)
select event_id, (['document_rejected', 'security_flag', 'field_decision', 'chat_interaction', 'human_confirmation'])[event_id % 5 + 1] event_type, user_id::varchar advisor_id, case event_id % 5 when 0 then 'rejeté' when 1 then 'revue_prioritaire' when 2 then 'signale' when 3 then case when event_id % 2 = 0 then 'dans_perimetre' else 'hors_perimetre' end else case when event_id % 2 = 0 then 'corrigé_par_humain' else 'confirmé_par_humain' end end decision,
case event_id % 5 when 2 then t when 3 then 'answer' when 4 then case when event_id % 2 = 0 then 'x' else t end end as value, case event_id % 5 when 0 then '{"reason":"' || t || '"}' when 1 then '{"matched_patterns":["0","3"]}' when 2 then '{"reasons":["rule"]}' when 3 then '{"question":"' || t || '","sources":["a","b"]}' else '{"valeur_extraite_initiale":"' || t || '"}' end details from e""")
def audit_constructors(spark, sf_dir):
    """An audit event of one of the five kinds for each event."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("advisor_id"), F.col("event_id").cast("string").alias("session_id"), F.col("event_type").alias("t"))
    kind = lambda k: e.where(F.col("event_id") % 5 == k)
    even = F.col("event_id") % 2 == 0
    words = lambda *w: F.array(*map(F.lit, w))
    made = ops.rejected_events(kind(0), F.col("t"))
    made = made.unionByName(ops.security_events(kind(1), words("0", "3"))).unionByName(ops.decision_events(kind(2), F.col("t"), F.lit("signale"), words("rule")))
    made = made.unionByName(ops.chat_events(kind(3), F.col("t"), F.lit("answer"), even, words("b", "a", "b"))).unionByName(ops.confirmation_events(kind(4), F.when(even, "x").otherwise(F.col("t")), F.col("t"), F.lit(None).cast("string")))
    return made.select(F.col("session_id").cast("long").alias("event_id"), "event_type", "advisor_id", "decision", "value", "details")


@query("""with l as (select user_id, max(ts) tm from events where event_type = 'view' group by 1) select c_custkey, greatest(case when c_custkey % 2 = 0 then timestamp '2024-01-15' end, tm) last_login from customer left join l on c_custkey = user_id""")
def last_login(spark, sf_dir):
    k = F.col("c_custkey")
    accounts = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.lit("2024-01-15").cast("timestamp_ntz")).alias("last_login"))
    logins = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("c_custkey"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return ops.last_logins(accounts, logins, "c_custkey", "ts")


@query("""with o as (select o_orderkey, f field, o_orderkey % 4 = 0 amb, o_orderkey % 8 = 0 named from orders, (values ('nom'), ('prenom'), ('cin')) v(f)), h as (select *, amb and field <> 'cin' hit from o)
select o_orderkey, field, case when not hit then 'V' end as value, case when hit then 0.0 else 0.9 end::double confidence, case when hit then 'signale' else 'pre_rempli' end status, case when hit then 'Nom et prénom non distinguables automatiquement sur cette carte|Sélection manuelle obligatoire parmi : ' || case when named then 'A, B' else 'textes OCR à vérifier' end else '' end reasons from h""")
def ambiguous_names(spark, sf_dir):
    key = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, ("nom", "prenom", "cin")))).alias("field"), F.lit("V").alias("value"), F.lit(0.9).alias("confidence"), F.lit("pre_rempli").alias("status"), F.array().cast("array<string>").alias("reasons"))
    out = ops.ambiguous_identity(d, key % 4 == 0, F.when(key % 8 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")))
    return out.select("o_orderkey", "field", "value", "confidence", "status", F.array_join("reasons", "|").alias("reasons"))


@query("""with d as (select doc_id, '<<<DOCUMENT_CONTENT_START>>>' || chr(10) || text || chr(10) || '<<<DOCUMENT_CONTENT_END>>>' w from documents) select doc_id, md5(w) md5, length(w) n from d""")
def data_wrapping(spark, sf_dir):
    wrapped = ops.as_data(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(wrapped).alias("md5"), F.length(wrapped).cast("long").alias("n"))


@query(f"with {OPERATIONS} select o, mark = 'CREDIT: ' credit, mark = 'DEBIT: ' debit from ops")
def column_marker(spark, sf_dir):
    from ledgerloom.plans.statements import operations

    return operations(spark, sf_dir).select("o", ops.has_column_marker(F.col("raw"), "credit").alias("credit"), ops.has_column_marker(F.col("raw"), "debit").alias("debit"))


@query(f"with {OPERATIONS}, n as (select doc, count(*) filter (kind in (0, 1)) i, count(*) filter (kind = 3) c from ops group by 1) select doc, i = 0 or (c > 0 and doc % 2 = 0) needed from n")
def fallback_needed(spark, sf_dir):
    """Statements to be read again, where every second one's charges were lost."""
    from ledgerloom.plans.statements import operations

    docs, _ = written_statements(spark, sf_dir)
    found = operations(spark, sf_dir).groupBy("doc").agg(F.count_if(F.col("kind").isin(0, 1)).alias("i"), F.count_if(F.col("kind") == 3).alias("c"))
    needed = ops.fallback_needed(F.col("i"), F.lit(0), F.when(F.col("doc") % 2 == 0, 0).otherwise(F.col("c")), F.col("text"))
    return docs.join(found, "doc").select("doc", needed.alias("needed"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'nom|prenom' else 'nom|prenom|' || case when o_orderkey % 2 = 0 then 'devise' else 'z' || o_orderkey end || '|autre' end fields, case o_orderkey % 4 when 0 then 1 when 1 then 3 when 2 then 2 else 1 end page from orders")
def review_view(spark, sf_dir):
    """The fields that a review shows, and the page that it opens at."""
    key = F.col("o_orderkey")
    others = F.array(F.lit("nom"), F.when(key % 2 == 0, "devise").otherwise(written("z", key)), F.lit("transactions"), F.lit("autre"), F.lit("prenom"))
    pages = cases(key % 4, F.array(F.lit(0), F.lit(-1)), F.array(F.lit(None).cast("int"), F.lit(3), F.lit(2)), F.array(F.lit(2)), F.array().cast("array<int>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(ops.review_fields(["nom", "prenom"], others, key % 3 == 0), "|").alias("fields"), ops.first_page(pages).alias("page"))


@query("""with o as (select o_orderkey, o_orderkey % 4 k, floor(o_totalprice) x, o_orderdate d from orders)
select o_orderkey, case k when 0 then replace(format('{:,}', x::bigint), ',', ' ') || ' MAD' when 1 then case when o_orderkey % 20 = 1 then '4' else '4.25' end || ' %' when 2 then (o_orderkey % 30)::varchar || ' ans' else 'cdi' end shown, case k when 0 then strftime(d, '%d/%m/%Y') || ' à 10:30' when 1 then '—' when 2 then strftime(d, '%d/%m/%Y') || ' à 00:00' else 'hier' end as "at" from o""")
def display_values(spark, sf_dir):
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    field = cases(key % 4, *map(F.lit, ("prix_bien", "taux_annuel_indicatif", "anciennete_annees", "statut")))
    value = cases(key % 4, F.floor("o_totalprice").cast("string"), F.when(key % 20 == 1, "4.0").otherwise("4.250"), (key % 30).cast("string"), F.lit("cdi"))
    at = cases(key % 4, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:30:15Z")), F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit("hier"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ops.shown_value(field, value).alias("shown"), ops.shown_time(at).alias("at"))


@query("""with o as (select o_orderkey, o_orderkey % 5 k, floor(o_totalprice)::double x from orders)
select o_orderkey, case k when 0 then x when 1 then x + 1000 when 2 then 500000 when 3 then x else 500000 end::double purchase_price, case k when 2 then x else 1000 end::double contribution, case k when 3 then null else 20 end::integer duration_years, case k when 4 then 4.5 end::double annual_rate from o""")
def project_mapping(spark, sf_dir):
    """Profiles whose price, sum of financing, contribution, price and sum, or rate has changed."""
    key, x = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    k = key % 5
    slots = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    changed = cases(k, slots("prix_bien"), slots("montant_financement_souhaite"), slots("apport_personnel"), slots("montant_financement_souhaite", "prix_bien"), slots("taux_annuel_indicatif", "duree_souhaitee_annees"))
    profile = {"prix_bien": x, "montant_financement_souhaite": x, "apport_personnel": x, "duree_souhaitee_annees": F.lit(None).cast("int"), "taux_annuel_indicatif": F.lit(4.5)}
    project = {"purchase_price": F.lit(500000.0), "contribution": F.lit(1000.0), "duration_years": F.when(k != 3, 20), "annual_rate": F.lit(None).cast("double")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in ops.project_of(profile, project, changed).items()])


@query(f"""with {OPERATIONS}, c as (select doc, page, count(*) n, sum(([2, 1, 1, 2, 0, 2])[kind + 1]) w from ops group by all), b as (select doc.doc, p page, n, w, proven, bank from doc cross join (values (1), (2)) v(p) join c on c.doc = doc.doc and c.page = p)
select doc, page::integer page, (least(n + case when page = 1 and proven then 3 else 0 end, 8) + least(w, 8) + least(n + case when page = 1 then 1 + (bank < 4)::int else 0 end, 8) / 2.0)::double score from b""")
def statement_scores(spark, sf_dir):
    """How much of its operations each page of a statement shows."""
    docs, _ = written_statements(spark, sf_dir)
    lines = text_rows(docs, "doc", "text").groupBy("doc", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]).alias("lines"))  # a page's lines
    shown = lines.where(F.exists("lines", lambda x: x.contains(" | ")))
    return shown.select("doc", "page", ops.detail_score(F.col("lines")).cast("double").alias("score"))


@query("""with d as (select doc_id, lang, upper(text) u, length(text) n from documents),
s as (select doc_id, lang, least(n, 600) / 100.0 + 3 * (contains(u, 'CARTE NATIONALE')::int + contains(u, 'IDMAR')::int + contains(u, 'VALABLE')::int + contains(u, 'ADRESSE')::int + contains(u, 'NÉ')::int + contains(u, 'NE A')::int) + len(regexp_extract_all(u, '\\b\\d{2}[./-]\\d{2}[./-]\\d{4}\\b')) + 2 * len(regexp_extract_all(u, '\\b[A-Z]{1,2}\\d{5,8}\\b')) score from d)
select lang, arg_max(doc_id, (score, -doc_id)) doc_id, max(score)::double score from s group by 1""")
def best_variant(spark, sf_dir):
    """Of the texts of each language the one that would be the best reading of an identity card."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return ops.best_reading(d, ["lang"], ops.identity_score(F.col("text")), "doc_id").select("lang", "doc_id", F.col("score").cast("double").alias("score"))


#: Fields of orders as documents of two types; which are proven follows from the key.
FIELDS = """f as (select o_orderkey doc, (['bulletin', 'releve', 'autre'])[o_orderkey % 3 + 1] kind, unnest(['nom', 'net', 'date']) field from orders),
p as (select *, case when (doc + length(field)) % 5 = 0 then null else 'x' end as value, case when doc % 7 = 0 then 0.69 else 0.7 end::double confidence, case when doc % 11 = 0 then null else 1 end page, case when doc % 13 = 0 then ' ' else 'q' end as quote from f)"""


def _fields(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("doc"), cases(key % 3, *map(F.lit, ("bulletin", "releve", "autre"))).alias("kind"), F.explode(F.array(*map(F.lit, ("nom", "net", "date")))).alias("field"))
    doc = F.col("doc")
    return rows.select(
        "doc", "kind", "field", F.when((doc + F.length("field")) % 5 != 0, "x").alias("value"), F.when(doc % 7 == 0, 0.69).otherwise(0.7).alias("confidence"), F.when(doc % 11 != 0, 1).alias("page"), F.when(doc % 13 == 0, " ").otherwise("q").alias("quote"),
    )


@query(f"""with {FIELDS}, o as (select doc, kind, field, value is not null and confidence >= 0.7 and page is not null and trim(quote) <> '' ok from p), n as (select *, case kind when 'bulletin' then field in ('nom', 'net') when 'releve' then field = 'date' else false end need, case field when 'nom' then 1 when 'net' then 2 else 3 end pos from o)
select doc, kind <> 'autre' and bool_and(ok or not need) complete, coalesce(string_agg(case when need and not ok then field end, '|' order by pos), '') lost from n group by doc, kind""")
def complete_extractions(spark, sf_dir):
    fields = _fields(spark, sf_dir)
    from ledgerloom.operators.evidence import complete_documents

    return complete_documents(fields, fields.select("doc", "kind").distinct(), "doc", "kind", {"bulletin": ("nom", "net"), "releve": ("date",)})


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linestatus = 'F' then 'model' else 'ocr' end series from lineitem), n as (select l_orderkey, count(*) filter (series = 'ocr') > count(*) filter (series = 'model') o from l group by 1)
select l.* from l join n using (l_orderkey) where (series = 'ocr') = o""")
def preferred_evidence(spark, sf_dir):
    from ledgerloom.operators.evidence import preferred_series

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "F", "model").otherwise("ocr").alias("series"))
    return preferred_series(rows, "l_orderkey", "series", "model", "ocr").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "series")


@query(f"""with {OPERATIONS}, t as (select doc, strftime(day, '%Y-%m') m, round(sum(amount), 2) v from ops where kind = 3 and proven group by all)
select doc, 'banque' field, 'model' as value, 0.9::double confidence, true verified from doc union all select doc.doc, 'charge_mensuelle_credits', printf('%.2f', v), case when v is not null then 0.5 end, v is not null from doc left join t on t.doc = doc.doc
union all select doc, 'revenus_complementaires', null, null, false from doc""")
def derived_override(spark, sf_dir):
    """A model's figures of statements give way to what their marked lines say; where those say nothing, the field is empty."""
    from ledgerloom.operators.evidence import overridden_fields
    from ledgerloom.plans.statements import operations

    rows = operations(spark, sf_dir)
    docs = rows.select("doc").distinct()
    said = docs.select("doc", F.explode(F.array(*map(F.lit, ("banque", "charge_mensuelle_credits", "revenus_complementaires")))).alias("field"), F.lit("model").alias("value"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page"), F.lit("q").alias("quote"), F.lit(True).alias("verified"))
    charge = rows.where("kind = 3 and proven").groupBy("doc").agg(F.round(F.sum("amount"), 2).alias("v"))
    derived = charge.select("doc", F.lit("charge_mensuelle_credits").alias("field"), F.format_string("%.2f", "v").alias("value"), F.lit(0.5).alias("confidence"), F.lit(1).alias("page"), F.lit("q").alias("quote"))
    out = overridden_fields(said, derived, docs, "doc", ("charge_mensuelle_credits", "revenus_complementaires"))
    return out.select("doc", "field", "value", "confidence", "verified")


@query("""with e as (select event_type document_type, (['nom', 'net'])[event_id % 2 + 1] field_name, event_id % 3 = 0 or value > 100 changed from events) select document_type, field_name, count(*) n, round(avg(changed::int), 4) rate from e group by all""")
def confirmation_rates(spark, sf_dir):
    """Corrections among the human confirmations that events stand for, by type and field."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("document_type"), F.when(F.col("event_id") % 2 == 0, "nom").otherwise("net").alias("field_name"), F.lit("x").alias("original"), F.when((F.col("event_id") % 3 == 0) | (F.col("value") > 100), "y").otherwise("x").alias("confirmed"))
    return ops.correction_rates(ops.confirmation_events(rows, F.col("confirmed"), F.col("original"), F.lit(None).cast("string")), ["document_type", "field_name"])


@query("""with o as (select o_orderkey, floor(o_totalprice)::double c, (o_orderkey % 25 + 5)::integer y, (o_orderkey % 8 * 0.5 + 1.0)::double r from orders), p as (select *, floor(c * (r / 1200) / (1 - power(1 + r / 1200, -y * 12)) * 100 + 0.5) / 100 m from o)
select o_orderkey, 'Merci, j’ai bien noté : durée du crédit : ' || y || ' ans, montant à financer : ' || replace(format('{:,}', c::bigint), ',', ' ') || ' MAD et taux annuel indicatif : ' || replace(r::varchar, '.', ',') || ' %.' || chr(10) || chr(10) || 'La mensualité estimée est d’environ ' || replace(format('{:,.2f}', m), ',', ' ') || ' MAD par mois, hors assurance et frais. Cette estimation est indicative et non contractuelle.' answer from p""")
def simulation_answers(spark, sf_dir):
    from ledgerloom.functions.loans import annuity
    from ledgerloom.operators.finance import cents

    key = F.col("o_orderkey")
    capital, years, rate = F.floor("o_totalprice").cast("double"), (key % 25 + 5).cast("int"), (key % 8 * 0.5 + 1.0).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", ops.simulation_answer(capital, years, rate, cents(annuity(capital, rate, years * 12))).alias("answer"))


@query("""select page_id, case when page_id % 9 = 0 then 'none' when length(html) > 2000 then 'too large' when page_id % 4 = 1 then 'extension' when page_id % 4 = 2 then 'type' end reason from pages""")
def upload_check(spark, sf_dir):
    """Pages as uploads, a thousand bytes for each character: no file, large ones, other extensions, other types, unknown types."""
    k = F.col("page_id")
    name = F.when(k % 9 != 0, F.concat(F.lit("a.b"), k, cases(k % 4, *map(F.lit, (".PDF", ".html", ".jpeg", ".png")))))
    mime = cases(k % 4, F.lit("application/pdf"), F.lit("application/pdf"), F.lit("text/html"), F.lit(None).cast("string"))
    size = F.length("html").cast("long") * 1000
    return table(spark, sf_dir, "pages").select("page_id", ops.upload_control(name, size * 1.048576 * 5, mime).alias("reason"))
