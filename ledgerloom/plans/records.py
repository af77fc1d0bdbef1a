"""Queries on audit events, dossiers, rules and decisions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import records as ops
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}
REQUIRED = ["view", "signup", "purchase"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


RULES_SQL = """r as (select o_orderkey k, 'price_positive' rule, o_totalprice >= 200000 passed from orders union all select o_orderkey, 'status_present', nullif(o_orderstatus, 'P') in ('O') from orders
 union all select o_orderkey, 'date_past', o_orderdate <= timestamp '2000-01-01' from orders union all select o_orderkey, 'urgent', case when o_orderpriority = '1-URGENT' then null else o_orderpriority <> '5-LOW' end from orders)"""


def _rules(spark, sf_dir):
    rules = {
        "price_positive": F.col("o_totalprice") >= 200000, "status_present": F.nullif(F.col("o_orderstatus"), F.lit("P")).isin("O"), "date_past": F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp"),
        "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("boolean")).otherwise(F.col("o_orderpriority") != "5-LOW"),
    }
    return ops.rule_rows(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query(f"with {RULES_SQL} select k o_orderkey, rule, passed from r")
def rules_long(spark, sf_dir):
    return _rules(spark, sf_dir)


@query(f"""with {RULES_SQL}, s as (select k, count(*) total, count(*) filter (passed) passed, count(*) filter (not passed) failed, count(*) filter (passed is null) skipped from r group by k)
select k o_orderkey, total, passed, failed, skipped, case when passed + failed > 0 then round(passed / (passed + failed)::double, 2) else 0.0::double end score, failed = 0 valid from s""")
def rule_summary(spark, sf_dir):
    return ops.rule_summary(_rules(spark, sf_dir), "o_orderkey")


@query("""
with d as (select d.doc_id, case when length(trim(d.text)) > 0 then d.lang end v, quality * 0.9 conf, d.source <> 'src3' verified, n_chars > 5000 rf, coalesce(toxic, 0) = 1 sus from documents d left join labels l on d.doc_id = l.doc_id),
r as (select doc_id, v, conf, array_to_string(list_filter([case when not coalesce(verified, false) then 'source' end, case when conf is null then 'no confidence' when conf < 0.85 then 'low confidence' end, case when rf then 'rule' end, case when sus then 'security' end], lambda x: x is not null), '|') reasons from d)
select doc_id, case when v is null then 'absent' when reasons <> '' then 'signale' else 'pre_rempli' end status, case when v is null then '' else reasons end reasons from r
""")
def field_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = ops.field_decisions(d, F.when(F.length(F.trim("text")) > 0, F.col("lang")), F.col("quality") * F.lit(0.9), F.col("source") != "src3", F.col("n_chars") > 5000, F.col("toxic") == 1)
    return out.select("doc_id", "status", "reasons")


@query("select event_id, ts, event_type, value from events where user_id = 7 order by event_id desc limit 200")
def audit_trail(spark, sf_dir):
    return ops.audit_trail(table(spark, sf_dir, "events"), F.col("user_id") == 7, "event_id").select("event_id", "ts", "event_type", "value")


@query("""select event_id, user_id, event_type, 'document_traite' event, '{"k":' || cast(json_extract(props, '$.k') as varchar) || ',"value":' || cast(cast(round(value) as bigint) as varchar) || '}' details from events""")
def audit_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    details = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.round("value").cast("long").alias("value")))
    return e.select("event_id", "user_id", "event_type", F.lit("document_traite").alias("event"), details.alias("details"))


@query("""
select doc_id, 'document_rejete' event, 'empty' detail from documents where n_chars < 200
union all select doc_id, 'alerte_securite', 'toxic' from labels join documents using (doc_id) where toxic = 1 and n_chars >= 200
union all select doc_id, 'decision_champ', f from documents, (values ('lang'), ('source')) v(f) where n_chars >= 200
""")
def audit_fanout(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rejected = F.col("n_chars") < 200
    event = lambda name, detail: F.struct(F.lit(name).alias("event"), F.lit(detail).alias("detail"))
    events = F.when(rejected, F.array(event("document_rejete", "empty"))).otherwise(F.array_compact(F.array(F.when(F.col("toxic") == 1, event("alerte_securite", "toxic")), event("decision_champ", "lang"), event("decision_champ", "source"))))
    return d.select("doc_id", F.explode(events).alias("e")).select("doc_id", "e.*")


@query("""
with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn, first_value(value) over (partition by user_id, event_type order by ts, event_id) fv from events)
select user_id, event_type, event_id, ts, fv as value from r where rn = 1
""")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    half = F.col("event_id") % 2 == 0
    return ops.upsert(e.where(half), e.where(~half), ["user_id", "event_type"], ["ts", "event_id"], {"value": "ts"})


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return ops.delete_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("select c_custkey, lower(trim(c_name)) email from customer where lower(trim(c_name)) not in (select lower(trim(c_name)) from customer where c_nationkey < 10)")
def new_customers_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.lower(F.trim("c_name"))
    return ops.new_rows(c.select("c_custkey", "c_name"), c.where("c_nationkey < 10"), name, name).select("c_custkey", name.alias("email"))


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey = 42")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("select event_id, ts, event_type, cast(json_extract(props, '$.k') as bigint) k from events where user_id = 11 order by ts desc, event_id")
def documents_by_customer(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id = 11")
    return e.select("event_id", "ts", "event_type", F.from_json(F.coalesce("props", F.lit("{}")), "k bigint")["k"].alias("k")).orderBy(F.col("ts").desc(), "event_id")


@query("""
with l as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders where o_orderdate >= timestamp '2001-01-01')
select c_custkey, c_name, o_orderkey, o_totalprice from customer left join l on c_custkey = o_custkey and rn = 1
""")
def dossier_list(spark, sf_dir):
    o = ops.latest(table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    c = table(spark, sf_dir, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


STATUS_SQL = """
m as (select user_id, event_type t, max(value) v from events group by 1, 2),
a as (select user_id, count(*) filter (t in ('view', 'signup', 'purchase') and v >= 150) n, count(*) filter (t = 'view' and v >= 150) a, count(*) filter (t = 'signup' and v >= 150) b, count(*) filter (t = 'purchase' and v >= 150) c, max(v) top from m group by 1),
s as (select user_id, n::integer n_done, array_to_string(list_filter([case when a = 0 then 'view' end, case when b = 0 then 'signup' end, case when c = 0 then 'purchase' end], lambda x: x is not null), '|') missing, n = 3 complete, floor(n * 100 / 3.0)::integer progress,
 case when user_id % 10 = 0 then 'verified' when top >= 300 then 'to_correct' when n = 3 then 'ready' when n > 0 then 'to_check' else 'incomplete' end status from a)"""


def _status(events, done: int, wrong: int):
    e = events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    covered = ops.coverage(e, "user_id", "event_type", F.col("v") >= done, REQUIRED).join(e.groupBy("user_id").agg(F.max("v").alias("top")), "user_id")
    return ops.dossier_status(covered, F.col("user_id") % 10 == 0, F.col("top") >= wrong).drop("top")


def _counts(status):
    s = lambda v: F.count_if(F.col("status") == v)
    return status.agg(F.count("*").alias("total"), s("ready").alias("ready"), s("to_check").alias("to_check"), s("to_correct").alias("to_correct"), F.count_if("complete").alias("complete"))


@query(f"with {STATUS_SQL} select * from s")
def dossier_status(spark, sf_dir):
    return _status(table(spark, sf_dir, "events"), 150, 300)


@query(f"with {STATUS_SQL} select count(*) total, count(*) filter (status = 'ready') ready, count(*) filter (status = 'to_check') to_check, count(*) filter (status = 'to_correct') to_correct, count(*) filter (complete) complete from s")
def dashboard_counts(spark, sf_dir):
    return _counts(_status(table(spark, sf_dir, "events"), 150, 300))


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and (contains(lower(c_name), '07') or contains(lower(c_name), '#000000001'))")
def dashboard_filter(spark, sf_dir):
    name = F.lower("c_name")
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & (name.contains("07") | name.contains("#000000001"))).select("c_custkey", "c_name")


@query("""with d as (select doc_id, list_filter([case when n_chars > 10000 then 'too long' end, case when n_chars < 100 then 'too short' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null) r from documents left join labels using (doc_id))
select doc_id, array_to_string(r, ' ; ') reasons from d where len(r) > 0""")
def document_alerts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    r = F.array_compact(F.array(F.when(F.col("n_chars") > 10000, "too long"), F.when(F.col("n_chars") < 100, "too short"), F.when(F.col("toxic") == 1, "toxic")))
    return d.select("doc_id", F.array_join(r, " ; ").alias("reasons"), F.size(r).alias("n")).where("n > 0").drop("n")


@query("""with a as (select o_custkey, o_orderpriority, count(distinct o_orderstatus) n_values, max_by(o_orderstatus, (o_orderdate, o_orderkey)) v from orders group by 1, 2)
select o_custkey, o_orderpriority, n_values, case when n_values > 1 then 'conflict' else 'confirmed' end status, case when n_values = 1 then v end as value from a""")
def client_summary(spark, sf_dir):
    return ops.agreed_value(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "v"), ["o_custkey", "o_orderpriority"], "v", ["o_orderdate", "o_orderkey"])


@query("""
with a as (select c_custkey, count(distinct o_orderstatus) n, max_by(o_orderstatus, (o_orderdate, o_orderkey)) last, min(o_orderkey) first from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000 group by 1)
select c_custkey, case when n = 0 then 'missing' when n > 1 then 'conflict' when first % 2 = 0 then 'confirmed' else 'to_check' end state, case when n = 1 then last end proposal from a
""")
def field_proposal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    a = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(
        F.count_distinct("o_orderstatus").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"), F.min("o_orderkey").alias("first")
    )
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "conflict").when(F.col("first") % 2 == 0, "confirmed").otherwise("to_check")
    return a.select("c_custkey", state.alias("state"), F.when(F.col("n") == 1, F.col("last")).alias("proposal"))


@query("select event_type, count(*) n, round(avg(case when value > 100 then 1.0 else 0.0 end), 4) rate from events group by 1")
def correction_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 100).cast("double")), 4).alias("rate"))


@query("select l_orderkey, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end), 2) selected, count(*) filter (l_returnflag = 'R') n from lineitem group by 1")
def credit_selection(spark, sf_dir):
    chosen = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.when(chosen, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("selected"), F.count_if(chosen).alias("n"))


@query("""with c as (select o_custkey, year(o_orderdate)::integer y, count(*) n, min(o_orderdate) f from orders group by 1, 2), r as (select *, row_number() over (partition by o_custkey order by n desc, f, y) rn from c)
select o_custkey, y as "year", n from r where rn = 1""")
def statement_year(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("f"))
    w = Window.partitionBy("o_custkey").orderBy(F.col("n").desc(), "f", "year")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "year", "n")


@query("""with n as (select l_orderkey, count(*) filter (l_linestatus = 'F') m, count(*) filter (l_linestatus = 'O') o from lineitem group by 1)
select l_orderkey, case when o > m then 'ocr' when m > 0 then 'model' when o > 0 then 'ocr' end series from n""")
def prefer_complete(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("m"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    return n.select("l_orderkey", F.when(F.col("o") > F.col("m"), "ocr").when(F.col("m") > 0, "model").when(F.col("o") > 0, "ocr").alias("series"))


@query("with r as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) rn from events) select user_id, event_type, event_id from r where rn = 1")
def dedupe_exact(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "event_id")


@query("select user_id, bool_and(value is not null and event_type is not null) complete, count(*) n from events group by 1")
def complete_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(F.col("value").isNotNull() & F.col("event_type").isNotNull()).alias("complete"), F.count("*").alias("n"))


@query("""with v as (select l_orderkey, bool_or(l_quantity > 45) bad from lineitem group by 1) select l.l_orderkey, l_linenumber, case when l_discount > 0.05 then 'corrige' else 'confirme' end status from lineitem l join v on l.l_orderkey = v.l_orderkey where not bad""")
def confirm_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    bad = F.bool_or(F.col("l_quantity") > 45).over(Window.partitionBy("l_orderkey"))
    return li.withColumn("bad", bad).where("not bad").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, "corrige").otherwise("confirme").alias("status"))


@query("""select o_orderkey, case when regexp_matches(ltrim(o_orderpriority), '^[-=+@]') then '''' || o_orderpriority else o_orderpriority end priority, o_orderstatus from orders where o_orderstatus = 'O' and o_totalprice > 100000""")
def confirmed_export(spark, sf_dir):
    from ledgerloom.functions.text import csv_cell

    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice > 100000").select("o_orderkey", csv_cell(F.col("o_orderpriority")).alias("priority"), "o_orderstatus")


@query("""with t as (select user_id, bool_or(event_type = 'view' and value > 150) a, bool_or(event_type = 'signup' and value > 150) b, bool_or(event_type = 'purchase' and value > 150) c from events group by 1) select user_id, case when not a then 'view' when not b then 'signup' when not c then 'purchase' else 'done' end step from t""")
def journey_step(spark, sf_dir):
    done = {t: F.bool_or((F.col("event_type") == t) & (F.col("value") > 150)).alias(t) for t in REQUIRED}
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(*done.values())
    step = F.lit("done")
    for name in reversed(REQUIRED):
        step = F.when(~F.col(name), name).otherwise(step)
    return t.select("user_id", step.alias("step"))


@query("""
with g as (select c_custkey from customer where c_acctbal < 0), o as (select o_orderkey from orders where o_custkey in (select c_custkey from g))
select 'customer' as "table", c_custkey as "key", null::integer line from customer where c_custkey not in (select c_custkey from g)
union all select 'orders', o_orderkey, null from orders where o_orderkey not in (select o_orderkey from o)
union all select 'lineitem', l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from o)
""")
def delete_cascade(spark, sf_dir):
    names = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    tables = {t: table(spark, sf_dir, t).select(*c) for t, c in names.items()}
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    left = ops.cascade_delete(tables, [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")], "customer", gone)
    named = lambda t, k, line: left[t].select(F.lit(t).alias("table"), F.col(k).alias("key"), line.cast("int").alias("line"))
    return named("customer", "c_custkey", F.lit(None)).union(named("orders", "o_orderkey", F.lit(None))).union(named("lineitem", "l_orderkey", F.col("l_linenumber")))


@query("""
with n as (select o_orderkey, case when o_orderkey % 13 = 0 then 'no address' when o_orderkey % 17 <> 0 then '  Client' || (o_custkey % 4000) || '@Example.ORG ' end email, o_totalprice > 50000 enough from orders),
k as (select distinct 'client' || c_custkey || '@example.org' email from customer where c_nationkey < 5),
v as (select *, lower(trim(email)) as address from n),
j as (select *, case when email is null or not regexp_matches(address, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'email' when not enough then 'price' when address in (select email from k) then 'known' end r from v),
f as (select address, min(o_orderkey) first from j where r is null group by 1)
select o_orderkey, address email, coalesce(r, case when o_orderkey <> first then 'repeated' end) reason, coalesce(r, case when o_orderkey <> first then 'repeated' end) is null accepted from j left join f using (address)
""")
def insert_checked(spark, sf_dir):
    from ledgerloom.functions import text as T

    key = F.col("o_orderkey")
    raw = F.when(key % 13 == 0, "no address").when(key % 17 != 0, F.concat(F.lit("  Client"), F.col("o_custkey") % 4000, F.lit("@Example.ORG ")))
    new = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("email"), (F.col("o_totalprice") > 50000).alias("enough"))
    known = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.concat(F.lit("client"), "c_custkey", F.lit("@example.org")).alias("email"))
    out = ops.checked_insert(new, known, T.normal_email(F.col("email")), F.col("email"), ["o_orderkey"], {"email": T.valid_email(F.col("email")), "price": F.col("enough")})
    return out.select("o_orderkey", T.normal_email(F.col("email")).alias("email"), "reason", "accepted")
