"""Queries on loans, discrepancies and monthly figures, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import loans
from ledgerloom.operators import finance as ops
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


PAYMENT = "case when capital = 0 then 0 when rate = 0 then capital / months else capital * (rate / 1200.0) / (1 - pow(1 + rate / 1200.0, -months)) end"


@query(f"""
with o as (select o_orderkey, o_totalprice price, round(o_totalprice * 0.2, 2) own, 5 + o_orderkey % 26 as years, (o_custkey % 9) * 0.5::double as rate from orders),
p as (select *, price - own capital, years * 12 as months from o)
select o_orderkey, years, rate, round(capital, 2) capital, floor(({PAYMENT}) * 100 + 0.5) / 100 payment, floor(({PAYMENT} * months - capital) * 100 + 0.5) / 100 interest, null::varchar error from p
""")
def loan_payment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.round(F.col("o_totalprice") * 0.2, 2).alias("own"), (5 + F.col("o_orderkey") % 26).alias("years"), ((F.col("o_custkey") % 9) * F.lit(0.5)).alias("rate"))
    return ops.loan_payments(o, F.col("price"), F.col("own"), F.col("years"), F.col("rate")).select("o_orderkey", "years", "rate", "capital", "payment", "interest", "error")


@query(f"""
with p as (select o_orderkey, y::integer as years, o_totalprice * 0.8 capital, y * 12 as months, 4.5::double rate, c_acctbal income from orders join customer on o_custkey = c_custkey, (values (15), (20), (25)) v(y))
select o_orderkey, years, round(capital, 2) capital, round({PAYMENT}, 2) payment, round({PAYMENT} * months - capital, 2) + 0.0 interest, round({PAYMENT} * months, 2) total,
 case when income > 0 then round({PAYMENT} / income * 100, 2) end debt_ratio from p
""")
def loan_scenarios(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = ops.loan_scenarios(o, F.col("o_totalprice"), F.col("o_totalprice") - F.col("o_totalprice") * 0.8, F.array(F.lit(20), F.lit(15), F.lit(25), F.lit(15)), F.lit(4.5), F.col("c_acctbal"), F.lit(0.0))
    return out.select("o_orderkey", "years", "capital", "payment", "interest", "total", "debt_ratio")


@query("""
with c as (select c_custkey, c_acctbal income, (c_custkey % 1000)::double charges, 10000.0::double own, 20 as years, 4.5::double rate, 40.0::double ratio from customer),
a as (select *, greatest(0.0, income * ratio / 100 - charges) available, years * 12 as months from c),
l as (select *, available * (1 - pow(1 + rate / 1200.0, -months)) / (rate / 1200.0) loan from a)
select c_custkey, case when income > 0 then round(available, 2) end available, case when income > 0 then round(loan, 2) end loan, case when income > 0 then round(greatest(0.0, available * months - loan), 2) end interest,
 case when income > 0 then round(loan + own, 2) end max_price, case when income > 0 then round(charges / income * 100, 2) end current_ratio, case when income <= 0 then 'income' end error from l
""")
def borrowing_capacity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("charges", (F.col("c_custkey") % 1000).cast("double"))
    out = ops.borrowing_capacity(c, F.col("c_acctbal"), F.col("charges"), F.lit(10000.0), F.lit(20), F.lit(4.5), F.lit(40.0))
    return out.select("c_custkey", "available", "loan", "interest", "max_price", "current_ratio", "error")


@query("select c_custkey, case when c_acctbal > 0 then round((c_custkey % 1000)::double / c_acctbal, 6) end debt_ratio from customer")
def debt_ratio(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(loans.debt_ratio(F.col("c_acctbal"), (F.col("c_custkey") % 1000).cast("double")), 6).alias("debt_ratio"))


@query("""
with p as (select p_partkey, least(5 + p_size % 26, 30)::integer y from part),
d as (select p_partkey, y, case when y <= 7 then [y, least(30, y + 5), least(30, y + 10)] when y >= 28 then [greatest(5, y - 10), greatest(5, y - 5), y] else [greatest(5, y - 5), y, least(30, y + 5)] end a from p),
u as (select p_partkey, y, list_sort(list_distinct(a)) a from d),
f as (select p_partkey, y, list_sort((a || list_filter(range(5, 31)::integer[], lambda x: not list_contains(a, x)))[1:3]) a from u)
select p_partkey, y as years, array_to_string(a, '|') durations from f
""")
def default_durations(spark, sf_dir):
    y = F.least(5 + F.col("p_size") % 26, F.lit(30)).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", y.alias("years"), F.array_join(loans.default_durations(y).cast("array<string>"), "|").alias("durations"))


@query("""
with l as (select l_orderkey, round(sum(l_extendedprice), 2) e from lineitem group by 1),
r as (select o_orderkey, o_totalprice declared, e extracted, abs(e - o_totalprice) / abs(o_totalprice) ratio from orders left join l on o_orderkey = l_orderkey)
select o_orderkey, declared, extracted, round(ratio, 6) ratio, ratio <= 0.10 passed, case when ratio is null then null when ratio <= 0.10 then 'information' when ratio <= 0.30 then 'avertissement' else 'critique' end severity from r
""")
def discrepancy(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("extracted"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("declared")).join(e, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return ops.discrepancies(o, F.col("declared"), F.col("extracted")).select("o_orderkey", "declared", "extracted", "ratio", "passed", "severity")


STEADY = "m as (select k, median(total) med, count(*) as months from t group by k), d as (select t.k, max(case when med <> 0 then abs(total - med) / abs(med) end) dev from t join m on t.k = m.k group by t.k)"


@query(f"""
with t as (select o_custkey k, strftime(o_orderdate, '%Y-%m') p, round(sum(o_totalprice), 2) total from orders group by 1, 2), {STEADY}
select m.k o_custkey, months, case when not (months > 1 and (med = 0 or dev > 0.20)) then round(med, 2) end charge, case when not (months > 1 and (med = 0 or dev > 0.20)) then 0.5::double end confidence from m join d on m.k = d.k
""")
def credit_charge(spark, sf_dir):
    t = ops.monthly_totals(table(spark, sf_dir, "orders"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice"))
    return ops.credit_charge(t, "o_custkey")


@query(f"""
with t as (select user_id k, date_trunc('week', ts) p, round(sum(value), 2) total from events where event_type = 'purchase' group by 1, 2), {STEADY}
select m.k user_id, months, case when months > 1 and (med = 0 or dev > 0.30) then 0.0::double else round(med, 2) end income, case when months > 1 and (med = 0 or dev > 0.30) then 0.25::double when months >= 2 then 0.6::double else 0.4::double end confidence from m join d on m.k = d.k
""")
def complementary_income(spark, sf_dir):
    t = ops.monthly_totals(table(spark, sf_dir, "events").where("event_type = 'purchase'"), "user_id", F.date_trunc("week", "ts"), F.col("value"))
    return ops.complementary_income(t, "user_id")


@query("""
with r as (select o_custkey, o_totalprice v, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders),
a as (select o_custkey, count(v) n, percentile_disc(0.5) within group (order by v) low, percentile_disc(0.5) within group (order by v desc) high, min(v) mi, max(v) ma from r where rn <= 3 group by 1)
select o_custkey, n, round(low, 2) low, round(high, 2) high, case when n = 1 then 'single' when mi = ma then 'equal' when (ma - mi) / greatest(abs(low), 1.0) <= 0.2 then 'regular' else 'variable' end as "label" from a
""")
def median_low_high(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w).alias("rn")).where("rn <= 3")
    return ops.low_and_high_median(first, "o_custkey", "o_totalprice")
