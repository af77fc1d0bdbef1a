"""Queries on model answers and on recognised tables, both derived from the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import answers, geometry
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("""select event_id, case event_id % 6 when 4 then 'no_json' when 5 then 'not_object' end error, case when event_id % 6 < 4 then cast(json_extract(props, '$.k') as bigint) end k, case when event_id % 6 = 1 then 'a } b { "c"' when event_id % 6 < 4 then event_type end note from events""")
def model_object(spark, sf_dir):
    """Answers around the props of events: plain, in prose, after braces that are no JSON, before a second object, cut off, and a list."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 6
    note = F.when(kind == 1, 'a } b { "c"').otherwise(F.col("event_type"))
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), note.alias("note")))
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Voici le résultat :\n```json\n"), body, F.lit("\n```\nFin."))).when(kind == 2, F.concat(F.lit("Ensemble {x} vide : "), body)).when(kind == 3, F.concat(body, F.lit(' et {"k": -1}'))).when(kind == 4, F.concat(F.lit("Réponse "), F.regexp_replace(body, r"\}$", ""))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    out = answers.model_object(e.select("event_id", text.alias("text")), "text")
    return out.select("event_id", "error", F.try_variant_get("answer", "$.k", "long").alias("k"), F.try_variant_get("answer", "$.note", "string").alias("note"))


@query("""select l_orderkey, l_linenumber, strftime(l_shipdate, '%d/%m/%Y') "date", l_returnflag as type, case when l_linenumber = 7 then null else floor(l_extendedprice)::bigint::varchar end montant,
case when l_partkey % 4 = 0 then l_linenumber when l_partkey % 4 = 1 then l_suppkey when l_partkey % 4 = 2 then l_linenumber + 100 end page, case when l_partkey % 4 < 2 then 'own ' || l_suppkey when l_partkey % 4 = 2 then 'date ' || l_partkey end quote from lineitem""")
def unwrapped_fields(spark, sf_dir):
    """Lines as answers: page and quote of their own, a wrapped page, only within wrapped fields (one with a page that is no number), and none."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.col("l_partkey") % 4
    date, amount = F.date_format("l_shipdate", "dd/MM/yyyy"), F.when(F.col("l_linenumber") != 7, F.floor("l_extendedprice").cast("string"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    value = F.coalesce(text('"', amount, '"'), F.lit("null"))
    plain = text('"date":"', date, '","montant":', value, ',"type":"', F.col("l_returnflag"), '"')
    wrapped = text('"date":{"value":"', date, '","source":{"page":"x","quote":"date ', F.col("l_partkey"), '"}},"montant":{"value":', value, ',"source":{"page":', F.col("l_linenumber") + 100, ',"quote":"other"}},"type":{"value":"', F.col("l_returnflag"), '"}')
    own = F.when(kind == 0, text(',"page":', F.col("l_linenumber"), ',"quote":"own ', F.col("l_suppkey"), '"')).otherwise(text(',"page":{"value":', F.col("l_suppkey"), '},"quote":{"value":"own ', F.col("l_suppkey"), '"}'))
    body = F.when(kind < 2, text("{", F.when(F.col("l_linenumber") % 2 == 0, plain).otherwise(wrapped), own, "}")).when(kind == 2, text("{", wrapped, "}")).otherwise(text("{", plain, "}"))
    out = answers.unwrapped_fields(F.parse_json(body), ["date", "montant", "type"])
    return li.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in out.items()])


#: Pages of tokens: an order's lines as rows of a table, `RECU` where goods came back, with an amount near, far, in the other column or not at all.
TOKENS = """
t as (select l_orderkey pg, 10 + l_linenumber * 10 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) ord, l_linenumber * 30 + l_quantity / 10 y, 4 + l_quantity % 20 h, l_returnflag rf, l_partkey % 5 k, round(l_discount * 100)::integer d from lineitem),
hd as (select distinct pg, pg % 9 <> 0 ok from t),
tok as (select pg, 0 ord, 'Date' as text, 20.0 x0, 5.0 y0, 60.0 x1, 15.0 y1 from hd union all select pg, 1, 'Débit', 400, 5, 440, 15 from hd where ok union all select pg, 2, 'Crédit', 500, 6, 540, 16 from hd
 union all select pg, ord, case when rf = 'R' then 'VIREMENT REÇU DE X' else 'ACHAT Y' end, 100, y - h / 2, 300, y + h / 2 from t
 union all select pg, ord + 5000, '1 250,' || lpad(d::varchar, 2, '0') || case when k = 3 then ' DH' else '' end, case when k = 1 then 410 else 505 end, y + d * 4 - h / 2, case when k = 1 then 440 else 545 end, y + d * 4 + h / 2 from t where k <> 0),
b as (select pg, (x0 + x1) / 2 x, (y0 + y1) / 2 y, greatest(y1 - y0, 1) h, ord, text from tok where pg in (select pg from hd where ok) and (y0 + y1) / 2 > 16)
"""


def _tokens(spark, sf_dir):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")) + 10 + F.col("l_linenumber") * 10
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pg"), at.alias("at"), (F.col("l_linenumber") * 30 + F.col("l_quantity") / 10).alias("y"), (F.col("l_quantity") % 20 + 4).alias("h"), "l_returnflag", (F.col("l_partkey") % 5).alias("k"), F.round(F.col("l_discount") * 100).cast("int").alias("d")
    )
    token = lambda at, text, x0, y0, x1, y1: F.struct(at.alias("at"), text.alias("text"), *[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])
    y, half, k = F.col("y"), F.col("h") / 2, F.col("k")
    row = token(F.col("at"), F.when(F.col("l_returnflag") == "R", "VIREMENT REÇU DE X").otherwise("ACHAT Y"), F.lit(100), y - half, F.lit(300), y + half)
    shifted = y + F.col("d") * 4
    amount = token(F.col("at") + 5000, F.concat(F.lit("1 250,"), F.lpad(F.col("d").cast("string"), 2, "0"), F.when(k == 3, " DH").otherwise("")), F.when(k == 1, 410).otherwise(505), shifted - half, F.when(k == 1, 440).otherwise(545), shifted + half)
    body = t.select("pg", F.explode(F.array_compact(F.array(row, F.when(k != 0, amount)))).alias("t")).select("pg", "t.*")
    fixed = lambda at, text, x0, y0, x1, y1: token(F.lit(at), F.lit(text), *map(F.lit, (x0, y0, x1, y1)))
    heads = t.select("pg").distinct().select("pg", F.explode(F.array_compact(F.array(fixed(0, "Date", 20, 5, 60, 15), F.when(F.col("pg") % 9 != 0, fixed(1, "Débit", 400, 5, 440, 15)), fixed(2, "Crédit", 500, 6, 540, 16)))).alias("t")).select("pg", "t.*")
    return heads.unionByName(body).withColumn("width", F.lit(800))


@query(f"with {TOKENS} select pg, 470::bigint as \"left\", 600::bigint as \"right\", 16::bigint as \"top\" from hd where ok")
def credit_column(spark, sf_dir):
    return geometry.credit_column(_tokens(spark, sf_dir), "pg", "at", "width")


@query(f"with {TOKENS} select i.pg, i.ord as \"row\" from b i where i.text = 'VIREMENT REÇU DE X' and not exists (select 1 from b a where a.pg = i.pg and regexp_matches(a.text, '^1 250') and a.x between 470 and 600 and abs(i.y - a.y) <= greatest(18, 2.2 * i.h, 2.2 * a.h))")
def rows_without_amount(spark, sf_dir):
    return geometry.rows_without_amount(_tokens(spark, sf_dir), "pg", "at", "width")
