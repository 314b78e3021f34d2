"""Queries for customer views, evaluation, governance, operations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import sap, synthetic, textsearch
from lodestrata.operators import customer360, equipment, evaluation, operations, silver
from lodestrata.plans.equipment import READ_SQL, STATES_SQL, equipment_events, readings
from lodestrata.plans.registry import ORACLE, SILVER_SQL, query, silver_orders
from lodestrata.sources import readers
from lodestrata.sources.readers import table
from lodestrata.streaming import micro

_SUM = "s as (select o_custkey, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, round(avg(o_totalprice), 8) as average, cast(min(o_orderdate) as date) as first_order, cast(max(o_orderdate) as date) as last_order from orders group by 1)"


@query(f"with {_SUM} select * from s")
def customer_order_summary(spark, sf):
    return customer360.order_summary(table(spark, sf, "orders"))


_TOPN = """, p as (select customer_number, material_number, cast(sum(net_value) as double) as revenue from silver group by 1, 2),
q as (select *, round(100 * revenue / sum(revenue) over (partition by customer_number), 4) as share_pct, row_number() over (partition by customer_number order by revenue desc, material_number) as rank from p)
"""


@query(f"with {SILVER_SQL} {_TOPN} select * from q where rank <= 5")
def product_share_topn(spark, sf):
    return customer360.product_share(silver_orders(spark, sf), "customer_number", "material_number", "net_value", 5)


@query("""with s as (select o_custkey, cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) filter (where cast(o_orderdate as date) < date '2000-01-01'), 0) as double) as before, cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) filter (where cast(o_orderdate as date) >= date '2000-01-01'), 0) as double) as since from orders group by 1),
c as (select *, case when before > 0 then round(100 * (since - before) / before, 4) end as change_pct from s) select *, case when change_pct > 0 then 'up' when change_pct < 0 then 'down' else 'flat' end as arrow from c""")
def customer_yoy(spark, sf):
    return customer360.year_on_year(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2000-01-01")


@query("""with s as (select o_custkey, count(*) filter (where o_orderstatus = 'P') as open, count(*) filter (where o_orderstatus = 'F') as won, count(*) filter (where o_orderstatus = 'O') as lost,
cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) filter (where o_orderstatus = 'P'), 0) as double) as open_value, cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) filter (where o_orderstatus = 'F'), 0) as double) as won_value,
cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) filter (where o_orderstatus = 'O'), 0) as double) as lost_value from orders group by 1) select *, case when won + lost > 0 then round(100.0 * won / (won + lost), 1) end as win_rate from s""")
def opportunity_rollup(spark, sf):
    return customer360.opportunity_rollup(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", "F", "O")


@query("""with c as (select user_id, count(*) as cases, count(*) filter (where value > 50) as open, count(*) filter (where value > 50 and event_type = 'error') as open_urgent from events group by 1),
k as (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as r from events group by 1, 2),
t as (select user_id, string_agg(event_type || ' (' || n || ')', ', ' order by r) as top_kinds from k where r <= 3 group by 1) select * from c join t using (user_id)""")
def case_rollup(spark, sf):
    return customer360.case_rollup(table(spark, sf, "events"), "user_id", "event_type", F.col("value") > 50, F.col("event_type") == "error")


_STATUS = "st as (select o_orderkey, o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F') as b, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'N') as d from orders)"


@query(f"with {_STATUS} select o_orderkey, case when d and b then 'Delivered and Billed' when d then 'Delivered, Pending Billing' when b then 'Billed, Pending Delivery' else 'Open' end as lifecycle from st")
def order_status(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return customer360.order_status(table(spark, sf, "orders").select("o_orderkey"), items.where("l_linestatus = 'F'"), items.where("l_returnflag = 'N'"), "o_orderkey")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 400000 union select o_orderkey, o_totalprice from orders where cast(o_orderdate as date) >= date '2001-08-01' - 180")
def significant_orders_union(spark, sf):
    return customer360.significant(table(spark, sf, "orders"), "o_totalprice", 400000, "o_orderdate", "2001-08-01").select("o_orderkey", "o_totalprice")


def _sections_sql(titles: list[str]) -> str:
    """Puts rows of ``lines`` (key, n, place, line) under the heads (key, head)."""
    named = ", ".join(f"({n}, '{title}')" for n, title in enumerate(titles))
    return f"""t as (select key, n, '## ' || title || chr(10) || string_agg(line, chr(10) order by place, line) as text from lines join (values {named}) v(n, title) using (n) where line is not null group by key, n, title),
u as (select key, string_agg(text, chr(10) || chr(10) order by n) as text from t group by key),
documents_ as (select key, concat_ws(chr(10) || chr(10), head, text) as text from heads left join u using (key))"""


_CUSTOMER_DOCS = f"""with {SILVER_SQL} {_TOPN}, {_SUM}, yoy as ({{yoy}}), opp as ({{opp}}), kase as ({{kase}}),
rec as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where cast(o_orderdate as date) >= date '2001-08-01' - 180),
con as (select c_custkey, s_name, row_number() over (partition by c_custkey order by s_acctbal desc, s_suppkey) as r from customer join supplier on s_nationkey = c_nationkey),
heads as (select c_custkey as key, '# ' || c_name || chr(10) || 'Segment: ' || c_mktsegment as head from customer),
lines as (
  select o_custkey as key, 0 as n, 1 as place, printf('%d orders, total %.2f, from %s to %s', orders, total, cast(first_order as varchar), cast(last_order as varchar)) as line from s
  union all select customer_number, 1, rank, printf('%d. material %d: %.2f', rank, material_number, revenue) from q where rank <= 5
  union all select o_custkey, 2, 1, 'Trend: ' || arrow || coalesce(printf(' (%.1f%%)', change_pct), '') from yoy
  union all select o_custkey, 3, r, printf('- order %d on %s: %.2f', o_orderkey, cast(cast(o_orderdate as date) as varchar), o_totalprice) from rec where r <= 8
  union all select o_custkey, 4, 1, printf('Open: %d (%.2f), won: %d (%.2f), lost: %d (%.2f)', open, open_value, won, won_value, lost, lost_value) from opp
  union all select o_custkey, 4, 2, printf('Win rate: %.1f%%', win_rate) from opp where win_rate is not null
  union all select user_id, 5, 1, printf('Cases: %d, open: %d, urgent: %d', cases, open, open_urgent) from kase
  union all select user_id, 5, 2, printf('Most frequent: %s', top_kinds) from kase
  union all select c_custkey, 6, r, printf('- %s', s_name) from con where r <= 3
),
{_sections_sql(["Orders", "Products", "Order Trend", "Recent Orders", "Pipeline", "Support History", "Key Contacts"])}
select 'customer_' || key as doc_id, text from documents_"""


@query(_CUSTOMER_DOCS.format(yoy=ORACLE["customer_yoy"], opp=ORACLE["opportunity_rollup"], kase=ORACLE["case_rollup"]))
def customer_documents(spark, sf):
    """All sections; suppliers of a customer's nation stand in for contacts, events for cases."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    best = silver.top_n(table(spark, sf, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3)
    contacts = customers.join(best, F.col("s_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("s_name").alias("contact"), "rank")
    products = customer360.product_share(silver_orders(spark, sf), "customer_number", "material_number", "net_value", 5)
    sections = customer360.customer_sections(orders, products, customer_yoy(spark, sf), opportunity_rollup(spark, sf), case_rollup(spark, sf), contacts, "2001-08-01")
    return customer360.customer_documents(customers, sections)


@query(f"""with {SILVER_SQL}, k as (select * from silver where header_value > 400000 or order_date >= date '2001-08-01' - 180),
l as (select order_number, any_value(customer_number) as c, any_value(order_date) as d, any_value(header_value) as h, string_agg('{{"item_number":' || item_number || ',"material_number":' || material_number || ',"quantity":' || cast(quantity as varchar) || ',"net_value":' || cast(net_value as varchar) || '}}', ',' order by item_number) as lines from k group by 1)
select 'order_' || order_number as doc_id, '{{"order_number":' || order_number || ',"customer_number":' || c || ',"order_date":"' || cast(d as varchar) || '","header_value":' || cast(h as varchar) || ',"lines":[' || lines || ']}}' as body from l""")
def order_documents(spark, sf):
    """Large or recent orders only."""
    return customer360.order_documents(customer360.significant(silver_orders(spark, sf), "header_value", 400000, "order_date", "2001-08-01"))


_SENSOR_RANGES = [("click", 20.0, 60.0), ("view", 10.0, 80.0), ("purchase", 30.0, 70.0), ("signup", 5.0, 40.0), ("error", 0.5, 30.0)]
_EQUIPMENT_DOCS = READ_SQL + STATES_SQL + f""", rng(sensor, low, high) as (values {", ".join(map(str, _SENSOR_RANGES))}),
heads as (select equipment_id as key, printf('# Equipment %d' || chr(10) || 'Health Score: %d/100 (%s)', equipment_id, score, case when score < 25 then 'Critical' when score < 50 then 'Warning' when score < 75 then 'Good' else 'Excellent' end) as head
  from (select equipment_id, cast(floor(avg(value)) as int) % 101 as score from r group by 1)),
latest as (select * from r qualify row_number() over (partition by equipment_id, sensor order by ts desc, event_id desc) = 1),
stat as (select *, case when value > high * 1.2 or value < low * 0.8 then 'Critical' when value > high or value < low then 'Elevated' else 'Normal' end as status, row_number() over (partition by equipment_id order by sensor) as place from latest join rng using (sensor)),
half as (select *, row_number() over w as rn, count(*) over (partition by equipment_id, sensor) as n from r window w as (partition by equipment_id, sensor order by ts, event_id)),
tr as (select equipment_id, sensor, avg(value) filter (where rn <= n // 2) as a, avg(value) filter (where rn > n // 2) as b from half group by 1, 2),
trend as (select *, case when a is null or a = 0 then 'stable' when (b - a) / a > 0.05 then 'increasing' when (b - a) / a < -0.05 then 'decreasing' else 'stable' end as trend, row_number() over (partition by equipment_id order by sensor) as place from tr),
bad as (select *, row_number() over (partition by equipment_id order by ts desc, event_id desc) as place from r where quality <> 'GOOD'),
ev as (select *, row_number() over (partition by equipment_id order by event_ts desc, kind, state_to) as place from e where kind <> 'none'),
lines as (
  select equipment_id as key, 0 as n, place, printf('- %s: %.2f (normal %.1f-%.1f) %s', sensor, value, cast(low as double), cast(high as double), status) as line from stat
  union all select equipment_id, 1, place, printf('- %s: %.6f (%s)', sensor, round(b, 6), trend) from trend
  union all select equipment_id, 2, place, printf('- %s %s %.2f %s', cast(cast(ts as date) as varchar), sensor, value, quality) from bad where place <= 5
  union all select equipment_id, 3, place, printf('- %s %s: %s', cast(cast(event_ts as date) as varchar), kind, state_to) from ev where place <= 5
),
{_sections_sql(["Current Sensor Readings", "Sensors", "Anomaly History", "Maintenance History"])}
select 'equipment_' || key as doc_id, text from documents_"""


@query(_EQUIPMENT_DOCS)
def equipment_documents(spark, sf):
    r = readings(spark, sf)
    score = equipment.health_score(r).withColumn("label", equipment.health_label(F.col("score")))
    ranges = F.broadcast(spark.createDataFrame(_SENSOR_RANGES, "sensor string, low double, high double"))  # a row a kind of sensor
    return customer360.equipment_documents(score, customer360.equipment_sections(r, equipment_events(spark, sf), ranges))


_GROUPS = customer360.PRODUCT_GROUPS
_USES = "case p_type " + " ".join(f"when '{g}' then {u}" for g, (u, _) in _GROUPS.items() if g) + f" else {_GROUPS[''][0]} end"
_FINISH = "case p_type " + " ".join(f"when '{g}' then '{f}'" for g, (_, f) in _GROUPS.items() if g) + f" else '{_GROUPS[''][1]}' end"


@query(f"""with p as (select *, {_USES} as uses, {_FINISH} as finish from part)
select 'product_' || p_partkey as doc_id, '{{"material":' || p_partkey || ',"name":' || cast(to_json(p_name) as varchar) || ',"group":' || cast(to_json(p_brand) as varchar) || ',"type":' || cast(to_json(p_type) as varchar) || ',"size":' || p_size || ',"price":' || cast(cast(p_retailprice as decimal(18,2)) as varchar)
  || ',"description":' || cast(to_json(p_name || ' is used in ' || array_to_string(uses, ', ') || ', with ' || finish || '.') as varchar) || ',"applications":' || cast(to_json(uses) as varchar) || ',"finish":' || cast(to_json(finish) as varchar) || '}}' as body from p""")
def product_documents(spark, sf):
    return customer360.product_documents(table(spark, sf, "part"))


@query("""with s as (select event_type as metric, value as score, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
select metric, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as std, min(score) as min, max(score) as max, max(score) filter (where r = n // 2 + 1) as p50, max(score) filter (where r = least(cast(floor(n * 0.95) as bigint), n - 1) + 1) as p95 from s group by 1""")
def eval_distribution(spark, sf):
    return evaluation.distribution(table(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("value").alias("score")))


@query("""select event_id, 'magnitude' as metric, value as score, value >= 20 as passed from events union all select event_id, 'known_type', cast(event_type <> 'error' as int)::double, event_type <> 'error' from events""")
def eval_custom_metrics(spark, sf):
    metrics = {"magnitude": (F.col("value"), 20.0), "known_type": ((F.col("event_type") != "error").cast("int"), 1.0)}
    return evaluation.evaluated(table(spark, sf, "events"), "event_id", metrics)


@query("with c as (select user_id, bool_and(value < 200) as ok from events group by 1) select count(*) as cases, count(*) filter (where ok) as passed, round(100.0 * count(*) filter (where ok) / count(*), 1) as rate from c")
def eval_pass_rate(spark, sf):
    return evaluation.pass_rate(table(spark, sf, "events").withColumn("ok", F.col("value") < 200), "user_id", "ok")


@query("""with m as (select p_brand, avg(abs(p_retailprice - p_retailprice * (1 + (p_partkey % 40) / 100.0)) / abs(p_retailprice) * 100) as mape from part where p_retailprice <> 0 group by 1)
select p_brand, round(mape, 6) as mape, cast(case when mape <= 5 then 5 when mape <= 10 then 4 when mape <= 15 then 3 when mape <= 25 then 2 else 1 end as int) as score, mape <= 20 as passed from m""")
def mape_bands(spark, sf):
    part = table(spark, sf, "part").withColumn("predicted", F.col("p_retailprice") * (1 + (F.col("p_partkey") % 40) / 100))
    return evaluation.mape(part, "p_brand", "p_retailprice", "predicted")


@query("select event_id, value * 40 as ms, cast(case when value * 40 <= 1000 then 5 when value * 40 <= 2000 then 4 when value * 40 <= 3000 then 3 when value * 40 <= 5000 then 2 else 1 end as int) as score, value * 40 <= 5000 as passed from events")
def latency_bands(spark, sf):
    return evaluation.latency(table(spark, sf, "events").withColumn("ms", F.col("value") * 40), "event_id", "ms")


@query("select event_id, ts, event_type, value from events where event_type = 'error' and contains(props, '\"k\": 1') order by ts desc, event_id limit 50")
def log_search(spark, sf):
    found = operations.log_search(table(spark, sf, "events"), {"event_type": "error"}, {"props": '"k": 1'}, [F.desc("ts"), F.col("event_id")], 50)
    return found.select("event_id", "ts", "event_type", "value")


@query("select p_partkey, p_name from part where contains(lower(p_name), '1') or contains(lower(p_brand), '1') or contains(lower(p_type), '1') or contains(cast(p_partkey as varchar), '1')")
def multi_column_search(spark, sf):
    return operations.substring_search(table(spark, sf, "part"), "1", ["p_name", "p_brand", "p_type", "p_partkey"]).select("p_partkey", "p_name")


@query("select o_orderkey, case o_orderstatus when 'F' then 'Closed Won' when 'O' then 'Prospecting' else 'Unknown' end as stage, case o_orderstatus when 'F' then 100 when 'O' then 10 else 0 end as probability from orders")
def value_maps(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", sap.mapped(s, {"F": "Closed Won", "O": "Prospecting"}, "Unknown").alias("stage"), sap.mapped(s, {"F": 100, "O": 10}, 0).alias("probability"))


@query("with s as (select time_bucket(interval 1 hour, ts) as start, sum(value) as total from events group by 1) select start, round(total, 4) as total from s where total > 800")
def windowed_sum_alert(spark, sf):
    out = operations.windowed_alert(table(spark, sf, "events"), "ts", "value", "1 hour", 800)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select event_type, user_id, count(*) as n from events where event_type = 'error' group by 1, 2 order by n desc, event_type, user_id limit 20")
def top_error_groups(spark, sf):
    return operations.top_groups(table(spark, sf, "events").where("event_type = 'error'"), ["event_type", "user_id"], 20)


@query("""with s as (select c_mktsegment as service, sum(cast(c_acctbal as decimal(18,2))) as cost from customer where c_acctbal > 0 group by 1)
select service, cast(cost as double) as cost, round(100 * cast(cost as double) / cast(sum(cost) over () as double), 4) as share_pct, round(cast(cost as double) / 12 * 30, 4) as projected from s where cost > 0.001 order by cost desc, service limit 10""")
def cost_share_projection(spark, sf):
    costs = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_mktsegment").alias("service"), F.col("c_acctbal").cast("decimal(18,2)").alias("c"))
    doubles = costs.groupBy("service").agg(F.sum("c").cast("double").alias("c"))
    return operations.cost_shares(doubles, "service", "c", 10, 12, 30)


@query("select count(*) as runs, count(*) filter (where o_orderstatus = 'F') as succeeded, round(100.0 * count(*) filter (where o_orderstatus = 'F') / count(*), 1) as success_pct from orders")
def pipeline_status(spark, sf):
    return operations.status_summary(table(spark, sf, "orders"), "o_orderstatus", "F")


@query("select o_orderstatus as status, count(*) as runs, round(100.0 * count(*) / sum(count(*)) over (), 1) as share_pct from orders group by 1")
def pipeline_status_counts(spark, sf):
    return operations.runs_by_status(table(spark, sf, "orders"), "o_orderstatus")


_CLASSES = ", ".join(f"case when regexp_matches(lower(column_name), '{'|'.join(p)}') then '{n}' end" for n, p in operations.COLUMN_CLASSES.items())
_TABLES = ("customer", "orders", "part", "supplier")


@query("select t.n as table_name, c as column_name, array_to_string(list_filter([" + _CLASSES.replace("column_name", "c") + "], lambda x: x is not null), ',') as classes from (" + " union all ".join(f"select '{t}' as n, unnest(columns) as c from (select list(column_name) as columns from (describe {t}))" for t in _TABLES) + ") t")
def column_classification(spark, sf):
    names = [(t, c) for t in _TABLES for c in table(spark, sf, t).columns]
    return operations.classify_columns(spark.createDataFrame(names, "table_name string, column_name string"))


@query("with c as (select doc_id, " + ", ".join(f"cast(len(regexp_extract_all(coalesce(text, ''), '{p}')) as bigint) as {k}" for k, p in operations.PII.items()) + ") select * from c where ".replace(") select", " from documents) select", 1) + " + ".join(operations.PII) + " > 0")
def document_pii_types(spark, sf):
    return operations.pii_counts(table(spark, sf, "documents"), "doc_id", "text")


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window(spark, sf):
    out = micro.tumbling(table(spark, sf, "events"), "ts", "1 day", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with m as (select ts, unnest([0, 1, 2, 3]) as i from events), s as (select time_bucket(interval 15 minutes, ts) - i * interval 15 minutes as start from m) select start, count(*) as n from s group by 1""")
def sliding_window(spark, sf):
    return micro.sliding(table(spark, sf, "events"), "ts", "1 hour", "15 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hours then 0 else 1 end as fresh from events), r as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g)
select min(ts) as start, max(ts) + interval 2 hours as stop, user_id, count(*) as n, round(sum(value), 4) as total from r group by user_id, s""")
def session_window(spark, sf):
    out = micro.sessions(table(spark, sf, "events"), "ts", "2 hours", "user_id")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "user_id", "n", F.round("total", 4).alias("total"))


@query("select n, plant, line, 'EQ-' || plant || '-' || line || '-' || lpad(cast(n as varchar), 3, '0') as equipment_id from range(1, 6) t(n), (values ('1000'), ('2000')) p(plant), (values ('A'), ('B'), ('C')) l(line)")
def series_crossjoin(spark, sf):
    out = readers.series(spark, 5, plant=["1000", "2000"], line=["A", "B", "C"])
    return out.withColumn("equipment_id", F.concat_ws("-", F.lit("EQ"), "plant", "line", F.lpad(F.col("n").cast("string"), 3, "0")))


@query("""with a as (select n_nationkey, count(s_suppkey) as suppliers from nation left join supplier on s_nationkey = n_nationkey group by 1), m as (select distinct c_mktsegment from customer)
select unnest(range(1, suppliers + 1)) as n, n_nationkey, c_mktsegment, 'EQ-' || n_nationkey || '-' || c_mktsegment || '-' || lpad(cast(unnest(range(1, suppliers + 1)) as varchar), 3, '0') as equipment_id from a cross join m""")
def series_over_tables(spark, sf):
    """Every nation with every market segment, and a number for each of the nation's suppliers."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("suppliers"))
    out = readers.series_by(nations, "suppliers", table(spark, sf, "customer").select("c_mktsegment").distinct())
    return out.select("n", "n_nationkey", "c_mktsegment", F.concat_ws("-", F.lit("EQ"), "n_nationkey", "c_mktsegment", F.lpad(F.col("n").cast("string"), 3, "0")).alias("equipment_id"))


@query("""with k as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as r, count(*) over () as n from supplier) select o_orderkey, s_suppkey from orders join k on r = o_orderkey % n""")
def lateral_pick(spark, sf):
    """The k-th supplier for each order: places of the suppliers, then an equal join."""
    suppliers = operations.numbered(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")
    count = F.broadcast(table(spark, sf, "supplier").agg(F.count("*").alias("n")))  # one row
    return table(spark, sf, "orders").crossJoin(count).withColumn("r", F.col("o_orderkey") % F.col("n")).join(suppliers, "r").select("o_orderkey", "s_suppkey")


@query("select c_custkey, t.kind as kind, t.days as days from customer, (values ('inspection', 30), ('repair', 90), ('overhaul', 365)) t(kind, days) where c_custkey % t.days < 10")
def event_templates(spark, sf):
    """Literal templates per row, filtered by a predicate over both."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(d).alias("days")) for k, d in (("inspection", 30), ("repair", 90), ("overhaul", 365))))
    return table(spark, sf, "customer").select("c_custkey", F.inline(kinds)).where("c_custkey % days < 10")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' order by o_orderkey offset 40 limit 20")
def paginate(spark, sf):
    return operations.page(table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 40, 20)


@query("select o_orderkey, o_orderpriority from orders order by case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, o_totalprice desc, o_orderkey limit 25")
def custom_sort(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, sf, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@query("select o_orderstatus, count(*) as n from orders where o_totalprice > 100000 group by 1")
def safe_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("guarded_orders")
    return operations.safe_sql(spark, "select o_orderstatus, count(*) as n from guarded_orders where o_totalprice > 100000 group by 1;")


@query("select c_custkey, coalesce(try_cast(v as double), 0) as v from (select c_custkey, case c_custkey % 4 when 0 then '12.5' when 1 then 'abc' when 2 then '' else null end as v from customer)")
def numeric_coercion(spark, sf):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "12.5").when(k == 1, "abc").when(k == 2, "")
    return table(spark, sf, "customer").select("c_custkey", readers.numeric_or_zero(raw).alias("v"))


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""with t as (select p_partkey, p_name, {_TRIGRAMS.format("p_name")} as x, {_TRIGRAMS.format("'colt wigdet'")} as y from part),
s as (select p_partkey, p_name, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as similarity from t) select * from s where similarity > 0.3""")
def trigram_search(spark, sf):
    """Names that resemble a misspelt one."""
    near = textsearch.trigram_similarity(F.col("p_name"), F.lit("colt wigdet"))
    return table(spark, sf, "part").select("p_partkey", "p_name", F.round(near, 6).alias("similarity")).where("similarity > 0.3")


def _uniform_sql(seed: str, *keys: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'cast({k} as varchar)' for k in keys)})), 1, 8) as bigint) / 4294967296::double"


_KINDS_SQL = ", ".join(f"('{s}', {lo}, {hi}, {places}, '{unit}')" for s, (lo, hi, places, unit) in synthetic.SENSORS.items())


@query(f"""with k(sensor, lo, hi, places, unit) as (values {_KINDS_SQL}), d as (select c_custkey, sensor, unit, places, lo + {_uniform_sql('7', 'c_custkey', 'sensor')} * (hi - lo) as raw, {_uniform_sql('7q', 'c_custkey', 'sensor')} as luck from customer, k)
select c_custkey, sensor, case places when 1 then round(raw, 1) when 2 then round(raw, 2) else round(raw, 3) end as value, unit, case when luck < 0.02 then 'BAD' when luck < 0.05 then 'UNCERTAIN' else 'GOOD' end as quality from d""")
def seeded_sensor_readings(spark, sf):
    return synthetic.sensor_readings(table(spark, sf, "customer"), "c_custkey", 7)


@query(f"""select o_orderkey, round(10 * sin(2 * pi() * dayofyear(o_orderdate) / 365), 6) as season, round(sqrt(-2 * ln(1 - {_uniform_sql('5a', 'o_orderkey')})) * cos(2 * pi() * {_uniform_sql('5b', 'o_orderkey')}), 6) as noise,
round(-ln(1 - {_uniform_sql('5.0', 'o_orderkey')}) - ln(1 - {_uniform_sql('5.1', 'o_orderkey')}), 6) as delay from orders""")
def seasonal_noise(spark, sf):
    """A yearly sine, a normal and a gamma draw for each order."""
    season = synthetic.seasonal(F.dayofyear(F.col("o_orderdate").cast("date")), 365, 10)
    cells = {"season": season, "noise": synthetic.normal(5, "o_orderkey"), "delay": synthetic.gamma(2, 5, "o_orderkey")}
    return table(spark, sf, "orders").select("o_orderkey", *(F.round(c, 6).alias(name) for name, c in cells.items()))


@query("select o_orderkey, o_orderpriority from orders where contains(cast(o_orderkey as varchar), '1') and o_orderstatus = 'F' and o_orderpriority = '3-MEDIUM'")
def ticket_search(spark, sf):
    found = operations.ticket_search(table(spark, sf, "orders"), "1", ["o_orderkey"], o_orderstatus="F", o_orderpriority="3-MEDIUM")
    return found.select("o_orderkey", "o_orderpriority")


@query("select count(*) as tickets, count(*) filter (where o_orderstatus = 'O') as open, count(*) filter (where o_orderstatus = 'P') as in_progress, count(*) filter (where o_orderstatus = 'F') as done from orders")
def ticket_counts(spark, sf):
    return operations.status_counts(table(spark, sf, "orders"), "o_orderstatus", {"O": "open", "P": "in_progress", "F": "done"})


@query("select o_orderkey, case o_orderstatus when 'O' then 'open' when 'P' then 'in-progress' else 'backlog' end as shown, case o_orderpriority when '1-URGENT' then 'U' when '2-HIGH' then 'H' else 'backlog' end as code from orders")
def reverse_value_map(spark, sf):
    """A map of statuses read forwards, and one of priorities read backwards."""
    shown = sap.mapped(F.col("o_orderstatus"), {"O": "open", "P": "in-progress"}, "backlog")
    code = sap.reverse_mapped(F.col("o_orderpriority"), {"U": "1-URGENT", "H": "2-HIGH"}, "backlog")
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("shown"), code.alias("code"))


@query("select * from customer where substr(md5(cast(c_custkey as varchar)), 1, 8) < 'cccccccc'")
def sample_fraction(spark, sf):
    return operations.sample_fraction(table(spark, sf, "customer"), "c_custkey", 0.8)


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey limit 3")
def head_sample(spark, sf):
    return operations.page(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0, 3)


@query("select o_orderstatus, count(*) as n from orders group by 1")
def catalog_table_scan(spark, sf):
    """A table read by its name in the catalog."""
    table(spark, sf, "orders").createOrReplaceTempView("catalog_orders")
    return readers.catalog_table(spark, "catalog_orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
