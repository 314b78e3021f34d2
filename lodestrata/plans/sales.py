"""Queries over orders: silver, star schema, KPIs and product metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import sap
from lodestrata.operators import gold, silver
from lodestrata.plans.registry import SILVER_SQL, query, silver_orders
from lodestrata.sources.readers import calendar, calendar_of, table

AS_OF = "2000-06-15"
_DATES = """
dates as (
  select cast(strftime(d, '%Y%m%d') as int) as date_key, cast(d as date) as full_date, year(d) as year, quarter(d) as quarter, month(d) as month, week(d) as week, day(d) as day_of_month,
    dayofweek(d) + 1 as day_of_week, dayofyear(d) as day_of_year, strftime(d, '%B') as month_name, strftime(d, '%A') as day_name,
    case when month(d) >= 7 then year(d) + 1 else year(d) end as fiscal_year,
    case when month(d) between 7 and 9 then 1 when month(d) >= 10 then 2 when month(d) <= 3 then 3 else 4 end as fiscal_quarter,
    dayofweek(d) in (0, 6) as is_weekend, strftime(d, '%Y-%m') as year_month, strftime(d, '%G-W%V') as year_week
  from (select unnest(generate_series(date '{0}', date '{1}', interval 1 day)) as d)
)
"""
_OWN_DATES = _DATES.replace("from (select unnest(generate_series(date '{0}', date '{1}', interval 1 day)) as d)", "from (select unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as d from orders)")
_FACT = """
fact as (
  select order_item_key, cast(strftime(order_date, '%Y%m%d') as int) as order_date_key, cast(strftime(ship_date, '%Y%m%d') as int) as ship_date_key,
    sha256(cast(material_number as varchar)) as product_key, sha256(cast(customer_number as varchar)) as customer_key, order_number, item_number, quantity, net_value,
    case when quantity > 0 then cast((2 * cast(net_value * 100 as hugeint) * 1000 + cast(quantity * 1000 as hugeint)) // (2 * cast(quantity * 1000 as hugeint)) / 100.0 as decimal(18,2)) end as unit_price, is_rejected
  from silver
)
"""


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, cast(l_shipdate as date) as l_shipdate from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc,
    l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) as r from lineitem) where r = 1""")
def dedup_latest_item(spark, sf):
    kept = silver.latest_items(table(spark, sf, "lineitem"))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("l_shipdate"))


@query("""select l_orderkey, l_linenumber, o_custkey, o_orderstatus, l_extendedprice, trim(coalesce(l_returnflag, o_orderstatus)) as flag from lineitem join orders on l_orderkey = o_orderkey""")
def header_item_join(spark, sf):
    items, headers = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return items.join(headers, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus", "l_extendedprice", sap.fallback(F.col("l_returnflag"), F.col("o_orderstatus")).alias("flag"))


_SILVER_COLUMNS = "order_item_key, order_number, item_number, customer_number, material_number, plant, order_type, cast(quantity as double) as quantity, cast(net_value as double) as net_value, cast(header_value as double) as header_value, order_date, ship_date, status, is_rejected"


@query(f"with {SILVER_SQL} select {_SILVER_COLUMNS} from silver")
def silver_order_items(spark, sf):
    return silver_orders(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("quantity", "net_value", "header_value")})


@query("select distinct sha256(concat_ws('||', cast(l_orderkey as varchar), cast(l_linenumber as varchar))) as item_key, sha256(cast(l_partkey as varchar)) as product_key from lineitem")
def surrogate_keys(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.select(sap.surrogate(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_key"), sap.surrogate(F.col("l_partkey").cast("string")).alias("product_key")).distinct()


@query("""with raw as (select o_orderkey, case when o_orderkey % 11 = 0 then '00000000' when o_orderkey % 13 = 0 then '' when o_orderkey % 17 = 0 then '20240231' when o_orderkey % 19 = 0 then null else strftime(o_orderdate, '%Y%m%d') end as raw, lpad(cast(o_orderkey as varchar), 10, '0') as padded, case when o_orderstatus = 'F' then ' ' when o_orderstatus = 'O' then null else 'X1' end as reason from orders)
select o_orderkey, raw, case when raw in ('', '00000000') then null else cast(try_strptime(raw, '%Y%m%d') as date) end as parsed, regexp_replace(padded, '^0+', '') as unpadded, coalesce(trim(reason) <> '', false) as is_rejected from raw""")
def sap_date_parse(spark, sf):
    key = F.col("o_orderkey")
    raw = F.when(key % 11 == 0, "00000000").when(key % 13 == 0, "").when(key % 17 == 0, "20240231").when(key % 19 == 0, None).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    reason = F.when(F.col("o_orderstatus") == "F", " ").when(F.col("o_orderstatus") == "O", None).otherwise("X1")
    rows = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"), F.lpad(key.cast("string"), 10, "0").alias("padded"), reason.alias("reason"))
    return rows.select("o_orderkey", "raw", sap.date8(F.col("raw")).alias("parsed"), sap.unpadded(F.col("padded")).alias("unpadded"), sap.flagged(F.col("reason")).alias("is_rejected"))


@query(f"with {SILVER_SQL}, {_FACT} select order_item_key, cast(unit_price as double) as unit_price from fact")
def unit_price(spark, sf):
    return gold.fact_sales(silver_orders(spark, sf)).select("order_item_key", F.col("unit_price").cast("double").alias("unit_price"))


@query(f"with {_DATES.format('2020-01-01', '2027-12-31')} select * from dates")
def dim_date(spark, sf):
    return gold.dim_date(calendar(spark, "2020-01-01", "2027-12-31"))


@query(f"with {_OWN_DATES} select dates.*, count(o_orderkey) as orders from dates left join orders on cast(o_orderdate as date) = full_date group by all")
def order_calendar(spark, sf):
    """The calendar from the first to the last day of the orders, with how many each day has."""
    orders = table(spark, sf, "orders")
    perday = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"))
    days = gold.dim_date(calendar_of(orders, "o_orderdate"))
    return days.join(perday, F.col("full_date") == F.col("day"), "left").withColumn("orders", F.coalesce("orders", F.lit(0))).drop("day")


@query(f"""with {_OWN_DATES} select is_weekend, fiscal_year, fiscal_quarter, year_week, count(*) as orders, count(distinct full_date) as days, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from dates join orders on cast(o_orderdate as date) = full_date group by all""")
def orders_by_calendar(spark, sf):
    """Orders by fiscal period, ISO week and weekend, over the calendar of their own days."""
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    dates = gold.dim_date(calendar_of(orders, "day"))
    own = orders.join(dates, F.col("day") == F.col("full_date")).groupBy("is_weekend", "fiscal_year", "fiscal_quarter", "year_week")
    return own.agg(F.count("*").alias("orders"), F.count_distinct("full_date").alias("days"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"""with {SILVER_SQL} select sha256(cast(material_number as varchar)) as product_key, material_number, plant, order_type from silver
qualify row_number() over (partition by material_number order by order_date desc, order_number desc, item_number desc) = 1""")
def dim_product(spark, sf):
    return gold.dimension(silver_orders(spark, sf), "material_number", ["plant", "order_type"], "product_key")


@query(f"""with {SILVER_SQL} select sha256(cast(customer_number as varchar)) as customer_key, customer_number, order_type, c_name, n_name from silver
join customer on c_custkey = customer_number join nation on n_nationkey = c_nationkey
qualify row_number() over (partition by customer_number order by order_date desc, order_number desc, item_number desc) = 1""")
def dim_customer(spark, sf):
    dim = gold.dimension(silver_orders(spark, sf), "customer_number", ["order_type"], "customer_key")
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return dim.join(named.select(F.col("c_custkey").alias("customer_number"), "c_name", "n_name"), "customer_number").select("customer_key", "customer_number", "order_type", "c_name", "n_name")


@query(f"with {SILVER_SQL}, {_FACT} select * exclude (quantity, net_value, unit_price), cast(quantity as double) as quantity, cast(net_value as double) as net_value, cast(unit_price as double) as unit_price from fact")
def fact_sales(spark, sf):
    return gold.fact_sales(silver_orders(spark, sf)).withColumns({c: F.col(c).cast("double") for c in ("quantity", "net_value", "unit_price")})


def _by(period):
    return f"with {SILVER_SQL}, {_FACT}, {_DATES.format('1994-01-01', '2003-12-31')} select {period}, cast(sum(net_value) as double) as revenue, count(distinct order_number) as orders from fact join dates on order_date_key = date_key where not is_rejected group by {period}"


@query(_by("fiscal_year, fiscal_quarter"))
def revenue_by_fiscal_quarter(spark, sf):
    dates = gold.dim_date(calendar(spark, "1994-01-01", "2003-12-31"))
    return gold.revenue_by(gold.fact_sales(silver_orders(spark, sf)), dates, "fiscal_year", "fiscal_quarter")


@query(_by("year, quarter"))
def revenue_by_calendar_quarter(spark, sf):
    dates = gold.dim_date(calendar(spark, "1994-01-01", "2003-12-31"))
    return gold.revenue_by(gold.fact_sales(silver_orders(spark, sf)), dates, "year", "quarter")


def _top(key):
    return f"with {SILVER_SQL} select {key}, cast(sum(net_value) as double) as revenue, cast(sum(quantity) as double) as quantity, count(distinct order_number) as orders from silver where not is_rejected group by 1 order by revenue desc, 1 limit 10"


@query(_top("material_number"))
def top_products(spark, sf):
    return gold.ranked_total(silver_orders(spark, sf), "material_number", 10)


@query(_top("customer_number"))
def top_customers(spark, sf):
    return gold.ranked_total(silver_orders(spark, sf), "customer_number", 10)


@query(f"""with {SILVER_SQL}, s as (select cast(sum(net_value) filter (where not is_rejected) as double) as r, count(distinct order_number) filter (where not is_rejected) as o,
  cast(sum(quantity) filter (where not is_rejected) as double) as q, count(*) filter (where is_rejected) as x, count(*) as n from silver)
select round(r, 2) as revenue, o as orders, round(r / o, 4) as average_order_value, round(r / q, 6) as average_unit_price, round(100.0 * x / n, 4) as rejection_rate from s""")
def kpi_summary(spark, sf):
    return gold.kpis(silver_orders(spark, sf))


@query(f"""with {SILVER_SQL} select order_type, count(*) filter (where is_rejected) as rejected, count(*) as items, round(100.0 * count(*) filter (where is_rejected) / count(*), 4) as rate,
coalesce(cast(sum(net_value) filter (where is_rejected) as double), 0.0) as rejected_value from silver group by 1""")
def rejection_analysis(spark, sf):
    return gold.sales_query(silver_orders(spark, sf), "rejection_analysis", "1990-01-01", "2010-12-31")


@query(f"""with {SILVER_SQL}, m as (select year(order_date) as year, month(order_date) as month, cast(sum(net_value) as double) as revenue from silver where not is_rejected group by all)
select m.year, m.month, m.revenue, p.revenue as prior, round(100 * (m.revenue - p.revenue) / p.revenue, 4) as yoy_pct from m left join m p on m.year = p.year + 1 and m.month = p.month""")
def sales_trend_yoy(spark, sf):
    return gold.trend(silver_orders(spark, sf))


@query(f"""with {SILVER_SQL}, t as (select customer_number, sum(net_value) as r from silver where not is_rejected group by 1), x as (select r from t order by r desc, customer_number limit 10)
select round(cast((select sum(r) from x) as double), 2) as top_revenue, round(100 * cast((select sum(r) from x) as double) / cast((select sum(r) from t) as double), 4) as share_pct""")
def customer_concentration(spark, sf):
    return gold.concentration(silver_orders(spark, sf), "customer_number", 10)


def _periods():
    starts = {"mtd": f"date_trunc('month', date '{AS_OF}')", "qtd": f"date_trunc('quarter', date '{AS_OF}')", "ytd": f"date_trunc('year', date '{AS_OF}')", "30d": f"date '{AS_OF}' - 29", "90d": f"date '{AS_OF}' - 89"}
    cols = ", ".join(f"cast(sum(net_value) filter (where order_date >= {s}) as double) as revenue_{p}, count(distinct order_number) filter (where order_date >= {s}) as orders_{p}" for p, s in starts.items())
    return f"with {SILVER_SQL} select {cols} from silver where not is_rejected and order_date <= date '{AS_OF}'"


@query(_periods())
def kpi_periods(spark, sf):
    return gold.period_kpis(silver_orders(spark, sf), F.lit(AS_OF).cast("date"))


@query(f"with {SILVER_SQL} select order_type, count(distinct order_number) as orders, cast(sum(net_value) as double) as value from silver where order_date between date '1998-01-01' and date '1998-12-31' and status = 'F' group by 1")
def order_analysis(spark, sf):
    return gold.sales_query(silver_orders(spark, sf), "order_analysis", "1998-01-01", "1998-12-31", {"status": "F"})


_MONTHLY = """
monthly as (
  select material_number, plant, cast(date_trunc('month', order_date) as date) as month_start, cast(sum(quantity) as double) as quantity, cast(sum(net_value) as double) as revenue, count(*) as lines,
    count(distinct order_number) as orders, count(distinct customer_number) as customers, round(cast(sum(p) as double) / count(p), 4) as avg_price, cast(min(p) as double) as min_price, cast(max(p) as double) as max_price,
    count(*) filter (where is_rejected) as rejected_lines, coalesce(cast(sum(net_value) filter (where is_rejected) as double), 0.0) as rejected_value
  from (select *, case when quantity > 0 then cast((2 * cast(net_value * 100 as hugeint) * 1000 + cast(quantity * 1000 as hugeint)) // (2 * cast(quantity * 1000 as hugeint)) / 100.0 as decimal(18,2)) end as p from silver) group by 1, 2, 3
)
"""


@query(f"with {SILVER_SQL}, {_MONTHLY} select * from monthly")
def monthly_product_metrics(spark, sf):
    return gold.monthly_metrics(silver_orders(spark, sf))


@query(f"""with {SILVER_SQL}, {_MONTHLY}, y as (select material_number, plant, month_start, revenue, lag(revenue) over (partition by material_number, plant, month(month_start) order by month_start) as prior_revenue from monthly)
select *, case when prior_revenue > 0 then round(100 * (revenue - prior_revenue) / prior_revenue, 4) end as yoy_pct from y""")
def yoy_growth(spark, sf):
    return gold.with_yoy(gold.monthly_metrics(silver_orders(spark, sf))).select("material_number", "plant", "month_start", "revenue", "prior_revenue", "yoy_pct")


@query(f"""with {SILVER_SQL} select n_name, year(order_date) as year, cast(sum(net_value) as double) as revenue from silver join customer on c_custkey = customer_number join nation on n_nationkey = c_nationkey where not is_rejected group by 1, 2""")
def star_revenue_by_nation(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    sold = silver_orders(spark, sf).where("not is_rejected").select("customer_number", "order_date", "net_value")
    return sold.join(named, F.col("customer_number") == F.col("c_custkey")).groupBy("n_name", F.year("order_date").cast("long").alias("year")).agg(F.sum("net_value").cast("double").alias("revenue"))


@query(f"""with {SILVER_SQL}, {_MONTHLY} select m.material_number, m.plant, m.month_start, m.revenue, p.revenue as prior_revenue from monthly m left join monthly p
on m.material_number = p.material_number and m.plant = p.plant and m.month_start = cast(p.month_start + interval 12 month as date)""")
def yoy_exact_self_join(spark, sf):
    m = gold.monthly_metrics(silver_orders(spark, sf)).select("material_number", "plant", "month_start", "revenue")
    before = m.select("material_number", "plant", F.add_months("month_start", 12).alias("month_start"), F.col("revenue").alias("prior_revenue"))
    return m.join(before, ["material_number", "plant", "month_start"], "left")


@query("select l_orderkey as order_number, round(sum(l_extendedprice), 2) as items_total, any_value(round(o_totalprice, 2)) as header_total from lineitem join orders on l_orderkey = o_orderkey group by 1")
def header_total(spark, sf):
    total = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_number")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("items_total"))
    return total.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_number"), F.round("o_totalprice", 2).alias("header_total")), "order_number")


@query(f"with {SILVER_SQL}, o as (select order_number, min(order_date) as ordered, max(ship_date) as shipped from silver where not is_rejected group by 1) select count(*) as orders, count(*) filter (where shipped <= ordered + 60) as on_time, round(count(*) filter (where shipped <= ordered + 60) / count(*), 6) as fill_rate from o")
def fill_rate(spark, sf):
    return gold.fill_rate(silver_orders(spark, sf), 60)


def _compared_sql(kind, first, last):
    now, before = "order_date between date '2000-01-01' and date '2000-03-31'", f"order_date between date '{first}' and date '{last}'"
    total = "cast(coalesce(sum(net_value) filter (where {0}), 0) as double)"
    return f"""select '{kind}' as compare_with, {total.format(now)} as revenue, {total.format(before)} as prior_revenue, count(distinct order_number) filter (where {now}) as orders, count(distinct order_number) filter (where {before}) as prior_orders,
case when {total.format(before)} > 0 then round(100 * ({total.format(now)} - {total.format(before)}) / {total.format(before)}, 4) end as change_pct from silver where not is_rejected"""


@query(f"with {SILVER_SQL} {_compared_sql('previous_period', '1999-10-02', '1999-12-31')} union all {_compared_sql('same_period_last_year', '1999-01-01', '1999-03-31')}")
def sales_compare_with(spark, sf):
    both = (gold.compared(silver_orders(spark, sf), "2000-01-01", "2000-03-31", k).select(F.lit(k).alias("compare_with"), "*") for k in ("previous_period", "same_period_last_year"))
    return next(both).unionByName(next(both))


def _area_sql(area, column):
    return f"(select '{area}' as area, cast(row_number() over (order by v desc, k) as int) as rank, cast(k as varchar) as name, v as value from (select {column} as k, cast(sum(net_value) as double) as v from t where not is_rejected group by 1) order by v desc, k limit 3)"


@query(f"""with {SILVER_SQL}, t as (select * from silver where order_date between date '2000-01-01' and date '2000-12-31')
select 'revenue' as area, cast(1 as int) as rank, 'total' as name, cast(sum(net_value) filter (where not is_rejected) as double) as value from t
union all select 'volume', 1, 'total', cast(sum(quantity) filter (where not is_rejected) as double) from t
union all select 'rejections', 1, 'total', round(100.0 * count(*) filter (where is_rejected) / count(*), 4) from t
union all """ + " union all ".join(_area_sql(a, c) for a, c in gold.RANKED_AREAS.items()))
def executive_summary(spark, sf):
    return gold.executive_summary(silver_orders(spark, sf), "2000-01-01", "2000-12-31", ("revenue", "volume", "rejections", *gold.RANKED_AREAS))


@query("select c_custkey, c_name, c_mktsegment from customer")
def trim_projection(spark, sf):
    padded = table(spark, sf, "customer").select("c_custkey", *(F.concat(F.lit("  "), c, F.lit(" ")).alias(c) for c in ("c_name", "c_mktsegment")))
    return silver.trimmed(padded)


@query("""with t as (select c_custkey, case c_custkey % 4 when 0 then '' when 1 then 'n/a' when 2 then '12.345' else cast(c_custkey as varchar) end as v from customer)
select c_custkey, cast(try_cast(v as decimal(18,3)) as double) as quantity, cast(try_cast(v as decimal(18,2)) as double) as value from t""")
def decimal_cast(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "").when(k % 4 == 1, "n/a").when(k % 4 == 2, "12.345").otherwise(k.cast("string"))
    raw = table(spark, sf, "customer").select("c_custkey", text.alias("v"))
    return raw.select("c_custkey", sap.amount(F.col("v"), 3).cast("double").alias("quantity"), sap.amount(F.col("v"), 2).cast("double").alias("value"))
