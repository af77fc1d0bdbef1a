"""Queries on citations, on what may be written into fields and on decisions, with the SQL that checks them.

The driver's tables have no extracted fields, so claims are derived from them: conversations serve as documents of several pages (one a
turn), and what is claimed of a page is right or wrong in ways that the turn's number picks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import decisions, evidence
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


COLLAPSED = "lower(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"

#: Pages and claims. Kinds: right quote with other case, of another page, without a page, blank, without a value, with other white space.
CLAIMS = f"""
p as (select conv_id, turn + 1 page, any_value(text) as text from conversations group by all having count(*) = 1),
c as (select conv_id, page, (conv_id + page) % 6 kind, text from p),
f as (select conv_id, 'f' || page field, case when kind <> 4 then 'v' || page end as value, case when conv_id % 2 = 0 then 0.9 else 0.6 end confidence, case when kind = 1 then page + 1 when kind <> 2 then page end page,
 case when kind = 3 then '  ' when kind = 5 then replace(substring(text, 1, 60), ' ', '  ') else replace(substring(text, 3, 40), 'e', 'E') end as quote from c),
m as (select f.*, coalesce(f.value is not null and length({COLLAPSED.format('f.quote')}) > 0 and contains({COLLAPSED.format('p.text')}, {COLLAPSED.format('f.quote')}), false) verified from f left join p on f.conv_id = p.conv_id and f.page = p.page)"""


def _pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return pages.groupBy("conv_id", "page").agg(F.first("text").alias("text"), F.count("*").alias("n")).where("n = 1").drop("n")


def _claims(spark, sf_dir):
    c = _pages(spark, sf_dir).withColumn("kind", (F.col("conv_id") + F.col("page")) % 6)
    kind, page = F.col("kind"), F.col("page")
    quote = F.when(kind == 3, "  ").when(kind == 5, F.replace(F.substring("text", 1, 60), F.lit(" "), F.lit("  "))).otherwise(F.translate(F.substring("text", 3, 40), "e", "E"))
    return c.select(
        "conv_id", F.concat(F.lit("f"), page).alias("field"), F.when(kind != 4, F.concat(F.lit("v"), page)).alias("value"), F.when(F.col("conv_id") % 2 == 0, 0.9).otherwise(0.6).alias("confidence"),
        F.when(kind == 1, page + 1).when(kind != 2, page).alias("page"), quote.alias("quote"),
    )


@query(f"with {CLAIMS} select conv_id, field, value, case when verified then page end page, case when verified then quote end quote, verified from m")
def source_check(spark, sf_dir):
    return evidence.verified_sources(_claims(spark, sf_dir), _pages(spark, sf_dir), "conv_id").select("conv_id", "field", "value", "page", "quote", "verified")


@query(f"with {CLAIMS} select conv_id, field, case when verified then value end as value, case when verified then confidence else 0 end::double confidence, case when verified then page end page, value is not null and not verified released from m")
def recoverable_fields(spark, sf_dir):
    return evidence.released_fields(_claims(spark, sf_dir), _pages(spark, sf_dir), "conv_id").select("conv_id", "field", "value", "confidence", "page", "released")


#: Rules: 3 and 7 replace on every third conversation, 1 and 5 fill in on even ones, 9 finds fields that no claim names.
WRITTEN = """
r as (select conv_id, 'f' || page field, 'r' || k as value, k / 10.0 confidence, page, 'q' || k quote, k as rank, k in (3, 7) replaces from p, (values (1), (3), (5), (7)) t(k) where (k in (3, 7) and conv_id % 3 = 0 and page % k <> 1) or (k in (1, 5) and conv_id % 2 = 0 and page % k <> 2)
 union all select conv_id, 'g' || page, 'r9', 0.9, page, 'q9', 9, false from p where page = 1),
o as (select conv_id, field, case when verified then value end as value, case when verified then confidence else 0 end::double confidence, case when verified then page end page, case when verified then quote end quote from m),
b as (select conv_id, field, max(rank) filter (replaces) last, min(rank) filter (not replaces) first from r group by all),
j as (select coalesce(o.conv_id, b.conv_id) conv_id, coalesce(o.field, b.field) field, o.value, o.confidence, o.page, case when b.last is not null then b.last when o.value is null then b.first end rank, b.last from o full join b on o.conv_id = b.conv_id and o.field = b.field)
"""


@query(f"with {CLAIMS}, {WRITTEN} select j.conv_id, j.field, coalesce(r.value, j.value) as value, case when r.value is not null then r.confidence::double when j.value is not null then j.confidence end confidence, case when r.value is not null then r.page else j.page end page, case when j.last is not null then 'replaced' when j.value is not null then 'kept' when r.value is not null then 'filled' else 'empty' end origin from j left join r on j.conv_id = r.conv_id and j.field = r.field and j.rank = r.rank")
def field_writing(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rank, page, conv = F.col("rank"), F.col("page"), F.col("conv_id")
    replaces = rank.isin(3, 7)
    tried = pages.select("conv_id", "page", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 7)])).alias("rank")).where((replaces & (conv % 3 == 0) & (page % rank != 1)) | (~replaces & (conv % 2 == 0) & (page % rank != 2)))
    rules = tried.withColumn("field", F.concat(F.lit("f"), page)).unionByName(pages.where("page = 1").select("conv_id", "page", F.lit(9).alias("rank"), F.lit("g1").alias("field")))
    found = rules.select("conv_id", "field", F.concat(F.lit("r"), rank).alias("value"), (rank / 10).alias("confidence"), "page", F.concat(F.lit("q"), rank).alias("quote"), "rank", replaces.alias("replaces"))
    own = evidence.released_fields(_claims(spark, sf_dir), pages, "conv_id")
    out = evidence.written_fields(own, found, "conv_id")
    return out.select("conv_id", "field", "value", F.when(F.col("value").isNotNull(), F.col("confidence")).alias("confidence"), "page", "origin")


@query(f"""with q as (select vec, string_agg(w, ' ' order by i) passage from (select doc_id vec, unnest(string_split({COLLAPSED.format('text')}, ' ')[4:5 + doc_id % 4]) w, generate_subscripts(string_split({COLLAPSED.format('text')}, ' ')[4:5 + doc_id % 4], 1) i from documents where doc_id % 100 = 0) group by 1),
t as (select doc_id, {COLLAPSED.format('text')} folded from documents)
select q.vec passage_of, t.doc_id from q join t on contains(t.folded, q.passage) where length(q.passage) > 0""")
def passage_search(spark, sf_dir):
    """Passages of two to five words of every hundredth document, in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.split(T.collapse(F.col("text")), " ")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("passage_of"), F.array_join(F.slice(words, F.lit(4), (F.col("doc_id") % 4 + 2).cast("int")), " ").alias("passage"))
    return evidence.contained_quotes(asked, docs, "doc_id", F.col("passage"), T.collapse(F.col("text")), ["doc_id"]).select("passage_of", "doc_id")


@query("select doc_id, length(text)::bigint n_chars, len(string_split(text, ' '))::bigint n_blanks, md5(text) md5 from documents")
def content_once(spark, sf_dir):
    """Measures of each text, taken once for each distinct text."""
    measures = lambda d: d.select("digest", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", " ", -1)).cast("long").alias("n_blanks"), F.md5("text").alias("md5"))
    return evidence.computed_once(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", measures).drop("text")


#: Fields and rules of orders; `pri` is a part of `price` but not its prefix before `_`.
REVIEW = """
d as (select o_orderkey, f field, case f when 'price' then floor(o_totalprice)::bigint::varchar when 'status' then nullif(o_orderstatus, 'P') when 'date' then strftime(o_orderdate, '%Y-%m-%d') when 'urgent' then o_orderpriority else 'x' end as value,
 case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 0.5 else 0.95 end confidence, (o_orderkey + length(f)) % 4 <> 0 verified, o_orderkey % 50 = 0 suspicious from orders, (values ('price'), ('pri'), ('status'), ('date'), ('urgent')) v(f)),
r as (select o_orderkey, 'price_positive' rule, o_totalprice >= 200000 passed from orders union all select o_orderkey, 'price_max_bound', o_totalprice <= 300000 from orders union all select o_orderkey, 'status', nullif(o_orderstatus, 'P') in ('O') from orders
 union all select o_orderkey, 'date_past', o_orderdate <= timestamp '2000-01-01' from orders union all select o_orderkey, 'urgent', case when o_orderpriority = '1-URGENT' then null else o_orderpriority <> '5-LOW' end from orders),
e as (select o_orderkey, 'ecart_' || f rule, o_orderkey % 3 <> 0 passed from orders, (values ('price'), ('date')) v(f))"""


def _orders(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    given = {"price": F.floor("o_totalprice").cast("string"), "pri": F.lit("x"), "status": status, "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "urgent": F.col("o_orderpriority")}
    named = o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in given.items()])).alias("f")).select("o_orderkey", "f.*")
    fields = named.withColumns({"confidence": F.when(key % 7 == 0, F.lit(None).cast("double")).when(key % 5 == 0, 0.5).otherwise(0.95), "verified": (key + F.length("field")) % 4 != 0, "suspicious": key % 50 == 0})
    tests = {
        "price_positive": F.col("o_totalprice") >= 200000, "price_max_bound": F.col("o_totalprice") <= 300000, "status": status.isin("O"), "date_past": F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp"),
        "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("boolean")).otherwise(F.col("o_orderpriority") != "5-LOW"),
    }
    from ledgerloom.operators.records import rule_rows

    return fields, rule_rows(o, "o_orderkey", tests), rule_rows(o, "o_orderkey", {f"ecart_{f}": key % 3 != 0 for f in ("price", "date")})


@query(f"with {REVIEW} select d.o_orderkey, d.field, string_agg(r.rule, '|' order by r.rule) failures from d join r on d.o_orderkey = r.o_orderkey and (r.rule = d.field or starts_with(r.rule, d.field || '_')) where not r.passed group by all")
def rule_prefix(spark, sf_dir):
    fields, rules, _ = _orders(spark, sf_dir)
    return fields.join(decisions.failures_by_field(rules, "o_orderkey"), ["o_orderkey", "field"]).select("o_orderkey", "field", F.array_join("failures", "|").alias("failures"))


@query(f"""with {REVIEW}, x as (select d.*, value is not null and verified stands, (select list(r.rule order by r.rule) from r where r.o_orderkey = d.o_orderkey and not r.passed and (r.rule = d.field or starts_with(r.rule, d.field || '_'))) failures,
 exists (select 1 from e where e.o_orderkey = d.o_orderkey and e.rule = 'ecart_' || d.field and not e.passed) far from d),
y as (select *, list_filter([case when value is null then 'absent' end, case when value is not null and confidence is null then 'no confidence' end, case when value is not null and confidence < 0.85 then 'low confidence' end, case when value is not null and far then 'discrepancy' end,
 case when value is not null and not verified then 'no proof' end] || (case when stands then list_transform(coalesce(failures, []), lambda z: 'rule ' || z) else [] end) || [case when stands and suspicious then 'security' end], lambda z: z is not null) reasons from x),
z as (select *, case when value is null then 'absent' when len(reasons) > 0 then 'signale' else 'pre_rempli' end status from y),
g as (select o_orderkey, bool_or(status = 'signale' or suspicious) or o_orderkey in (select o_orderkey from r where not passed) priority from z group by 1)
select o_orderkey, field, case when stands then value end as value, case when value is not null and not verified then value end rejected_value, status, array_to_string(reasons, '|') reasons, priority from z join g using (o_orderkey)""")
def decision_review(spark, sf_dir):
    fields, rules, gaps = _orders(spark, sf_dir)
    return decisions.review_decisions(fields, rules, gaps, "o_orderkey")
