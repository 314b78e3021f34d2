"""Queries for the remaining join, set and text shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import docparse
from lodestrata.operators import demand, maintenance_model
from lodestrata.plans.demand import _DAILY, AS_OF, PLANT
from lodestrata.plans.registry import query, silver_orders
from lodestrata.sources.readers import table


@query("select l_orderkey, l_linenumber, l_extendedprice as value, o_totalprice as value_hdr, o_orderstatus from lineitem left join orders on l_orderkey = case when o_orderkey % 3 = 0 then o_orderkey end")
def left_merge_suffix(spark, sf):
    headers = table(spark, sf, "orders").select(F.expr("case when o_orderkey % 3 = 0 then o_orderkey end").alias("l_orderkey"), F.col("o_totalprice").alias("value_hdr"), "o_orderstatus")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value")).join(headers, "l_orderkey", "left")


@query("select o_orderkey, m.name as account from orders left join (select o_custkey % 100 as k, max(c_name) as name from orders join customer on o_custkey = case when c_custkey % 2 = 0 then c_custkey end group by 1) m on o_custkey % 100 = m.k")
def dictionary_lookup(spark, sf):
    """A map from keys to names, one name per key, joined like any table."""
    owners = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = case when c_custkey % 2 = 0 then c_custkey end"))
    names = owners.groupBy((F.col("o_custkey") % 100).alias("k")).agg(F.max("c_name").alias("account"))
    return table(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 100).join(names, "k", "left").select("o_orderkey", "account")


@query("""with a as (select o_custkey as k, count(*) as orders from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as k, count(*) as open from orders where o_orderstatus = 'P' group by 1)
select coalesce(a.k, b.k) as k, coalesce(orders, 0) as orders, coalesce(open, 0) as open from a full join b on a.k = b.k""")
def full_outer_merge(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("orders"))
    return a.join(o.where("o_orderstatus = 'P'").groupBy("k").agg(F.count("*").alias("open")), "k", "full_outer").fillna(0)


@query("select p_partkey, coalesce(sum(l_quantity), 0) as total_stock, coalesce(sum(l_quantity) filter (where l_linestatus = 'O'), 0) as available_stock from part left join lineitem on l_partkey = p_partkey group by 1")
def inventory_snapshot(spark, sf):
    q = F.col("l_quantity")
    items = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(q).alias("a"), F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("b"))
    return table(spark, sf, "part").select("p_partkey").join(items, "p_partkey", "left").select("p_partkey", F.coalesce("a", F.lit(0.0)).alias("total_stock"), F.coalesce("b", F.lit(0.0)).alias("available_stock"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def semi_join(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 450000")
    return table(spark, sf, "customer").select("c_custkey").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""select 'high' as band, o_orderkey from orders where o_totalprice > 400000 union all select 'early', o_orderkey from orders where o_orderdate < timestamp '1995-03-01'""")
def union_all(spark, sf):
    o = table(spark, sf, "orders")
    high = o.where("o_totalprice > 400000").select(F.lit("high").alias("band"), "o_orderkey")
    return high.unionByName(o.where("o_orderdate < timestamp_ntz '1995-03-01'").select(F.lit("early").alias("band"), "o_orderkey"))


@query("""with t as (select c_custkey, '# Customer ' || c_custkey || chr(10) || 'EQ-' || c_nationkey || '-A-' || c_custkey || chr(10) || 'Health Score | ' || (c_custkey % 101) || '/100' || chr(10) || 'High risk of ' || c_mktsegment as text from customer)
select c_custkey, 'Customer ' || c_custkey as title, regexp_extract(text, 'EQ-[0-9]+-[A-Za-z0-9_]+-[0-9]+') as equipment_id, cast(c_custkey % 101 as int) as score, 'High' as risk, concat_ws(',', case when contains(lower(text), 'auto') or contains(lower(text), 'machine') then 'machines' end, case when contains(lower(text), 'house') then 'homes' end) as cited from t""")
def document_metadata(spark, sf):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("# Customer "), k, F.lit("\nEQ-"), F.col("c_nationkey").cast("string"), F.lit("-A-"), k, F.lit("\nHealth Score | "), (F.col("c_custkey") % 101).cast("string"), F.lit("/100\nHigh risk of "), F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    t = F.col("text")
    cited = F.array_join(docparse.citations(t, {"machines": ["auto", "machine"], "homes": ["house"]}), ",")
    return rows.select("c_custkey", docparse.title(t).alias("title"), docparse.equipment_id(t).alias("equipment_id"), docparse.health_score(t).alias("score"), docparse.risk_word(t).alias("risk"), cited.alias("cited"))


@query(_DAILY + ", s as (select plant, avg(quantity) as m, coalesce(stddev_samp(quantity), 0) as d from byday group by 1) select plant, round(m, 6) as forecast, round(greatest(m - 1.96 * d, 0), 6) as low, round(m + 1.96 * d, 6) as high from s")
def demand_forecast(spark, sf):
    return maintenance_model.forecast(demand.daily(demand.base(silver_orders(spark, sf), AS_OF), PLANT), "plant")


@query("select c_mktsegment, count(*) as customers, row_number() over (order by count(*) desc, c_mktsegment) as place from customer group by 1")
def row_number_over_groups(spark, sf):
    from pyspark.sql.window import Window

    groups = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("customers"), "c_mktsegment")).cast("long"))
