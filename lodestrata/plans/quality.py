"""Queries for validation, data quality and history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.operators import bronze, quality, scd2
from lodestrata.plans.registry import ORACLE, query
from lodestrata.sources import readers, writers
from lodestrata.sources.readers import table

_GAPS = "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_custkey end as o_custkey, case when o_orderkey % 35 = 3 then null else o_orderstatus end as o_orderstatus, o_totalprice from orders"


def _gaps(spark, sf):
    """Orders with some nulls, by a rule on the key."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.when(k % 7 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(k % 35 != 3, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")


@query(f"with g as ({_GAPS}) select *, case when o_custkey is null then 'null o_custkey' else 'null o_orderstatus' end as _rejection_reason from g where o_custkey is null or o_orderstatus is null")
def required_field_split(spark, sf):
    return bronze.required_split(_gaps(spark, sf), ["o_custkey", "o_orderstatus"])[1]


@query(f"with g as ({_GAPS}) select * from g where o_custkey is not null and o_orderstatus is not null")
def required_field_valid(spark, sf):
    return bronze.required_split(_gaps(spark, sf), ["o_custkey", "o_orderstatus"])[0]


@query("""select n_nationkey, n_name, n_regionkey, 'batch1' as _bronze_batch_id, 'run1' as _bronze_pipeline_run_id, 'erp' as _bronze_source_system, 'nation' as _bronze_source_table, 'full' as _bronze_load_type,
sha256(concat_ws('||', cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar))) as _bronze_row_hash from nation""")
def bronze_metadata(spark, sf):
    out = bronze.with_lineage(table(spark, sf, "nation"), "erp", "nation", "batch1", "run1", "full", F.lit("2024-01-01").cast("timestamp"), F.col("_metadata.file_path"))
    return out.drop("_bronze_ingestion_timestamp", "_bronze_file_path")


@query(f"""with g as ({_GAPS}) select o_orderkey, sha256(concat_ws('||', cast(o_custkey as varchar), o_orderstatus)) as loose,
sha256(coalesce('=' || cast(o_custkey as varchar), 'null') || '||' || coalesce('=' || o_orderstatus, 'null')) as strict,
sha256('o_custkey=' || coalesce(cast(o_custkey as varchar), '') || '|o_orderstatus=' || coalesce(o_orderstatus, '')) as named from g""")
def row_hash(spark, sf):
    cols = ["o_custkey", "o_orderstatus"]
    return _gaps(spark, sf).select("o_orderkey", bronze.row_hash(cols).alias("loose"), bronze.row_hash_strict(cols).alias("strict"), bronze.named_hash(cols).alias("named"))


@query("select distinct l_orderkey, l_partkey, l_quantity from lineitem")
def distinct_rows(spark, sf):
    return bronze.distinct_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def landing_scan(spark, sf):
    return readers.landing_scan(spark, f"{sf}/orders.parquet", schema="o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


_LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("with l as (select unnest([" + ", ".join(f"'{t}'" for t in (*_LISTED, "archive")) + "]) as table_name), c as (" + " union all ".join(f"select '{t}' as table_name, count(*) as rows from {t}" for t in _LISTED) + ") select table_name, rows from l left join c using (table_name)")
def catalog_row_counts(spark, sf):
    """A listed table without statistics keeps its row."""
    listing = spark.createDataFrame([(t,) for t in (*_LISTED, "archive")], "table_name string")
    return readers.with_row_counts(listing, readers.row_counts({t: table(spark, sf, t) for t in _LISTED}))


@query("select max(o_orderdate) as watermark from orders where o_orderdate > timestamp '1998-06-01'")
def watermark_max(spark, sf):
    return readers.new_watermark(readers.since_watermark(table(spark, sf, "orders"), "o_orderdate", F.expr("timestamp_ntz '1998-06-01'")), "o_orderdate")


def _one(name, column, severity, failed, total, threshold, source):
    return f"select '{name}' as check_name, '{column}' as column_name, '{severity}' as severity, failed, total, round(failed / total, 6) as rate, failed / total <= {threshold} as passed from (select {failed} as failed, {total} as total from ({source}))"


@query(_one("not_null", "o_custkey", "critical", "count(*) filter (where o_custkey is null)", "count(*)", 0.05, _GAPS) + " union all " + _one("not_null", "missing", "critical", "count(*)", "count(*)", 0.05, _GAPS))
def dq_not_null(spark, sf):
    df = _gaps(spark, sf)
    return quality.run(df, [quality.not_null(df, "o_custkey"), quality.not_null(df, "missing")])


@query(_one("unique", "l_orderkey,l_linenumber", "critical", "count(*) - count(distinct (l_orderkey, l_linenumber))", "count(*)", 0.01, "select * from lineitem"))
def dq_unique(spark, sf):
    df = table(spark, sf, "lineitem")
    return quality.run(df, [quality.unique(df, ["l_orderkey", "l_linenumber"])])


@query(_one("value_range", "l_quantity", "warning", "count(*) filter (where l_quantity < 2 or l_quantity > 49)", "count(*)", 0.02, "select * from lineitem"))
def dq_value_range(spark, sf):
    df = table(spark, sf, "lineitem")
    return quality.run(df, [quality.value_range(df, "l_quantity", 2, 49)])


@query("""with k as (select distinct o_custkey as k from orders), o as (select k from k except select case when c_custkey % 10 <> 0 then c_custkey else -c_custkey end as c_custkey from customer), s as (select (select count(*) from o) as failed, (select count(*) from k) as total)
select 'referential_integrity' as check_name, 'o_custkey' as column_name, 'critical' as severity, failed, total, round(1 - failed / total, 6) as rate, 1 - failed / total >= 0.95 as passed from s""")
def dq_referential_integrity(spark, sf):
    return quality.referential_integrity(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").select(F.expr("case when c_custkey % 10 <> 0 then c_custkey else -c_custkey end as c_custkey")), "c_custkey")


@query(_one("date_validity", "d", "warning", "count(*) filter (where d < date '1995-06-01' or d > date '2001-01-01')", "count(d)", 0.02, "select cast(o_orderdate as date) as d from orders"))
def dq_date_validity(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return quality.run(df, [quality.date_validity(df, "d", "1995-06-01", "2001-01-01")])


_REPORT = " union all ".join(
    f"select '{t}' as table_name, * from ({sql})"
    for t, sql in (
        ("raw_sales_orders_header", _one("not_null", "o_custkey", "critical", "count(*) filter (where o_custkey is null)", "count(*)", 0.02, _GAPS)),
        ("raw_sales_orders_header", _one("unique", "o_orderkey", "critical", "count(*) - count(distinct o_orderkey)", "count(*)", 0.005, _GAPS)),
        ("raw_iot_telemetry", _one("not_null", "value", "critical", "count(*) filter (where value is null)", "count(*)", 0.10, "select case when event_id % 13 <> 0 then value end as value from events")),
        ("raw_iot_telemetry", _one("value_range", "value", "warning", "count(*) filter (where value < 0 or value > 100)", "count(*)", 0.02, "select case when event_id % 13 <> 0 then value end as value from events")),
        ("cleaned_customers", _one("not_null", "c_name", "critical", "count(*) filter (where c_name is null)", "count(*)", 0.05, "select * from customer")),
    )
)


@query(f"with r as ({_REPORT}) select *, not bool_or(severity = 'critical' and not passed) over () as run_passed from r")
def dq_report(spark, sf):
    """Three tables, two of them with thresholds of their own."""
    orders, customers = _gaps(spark, sf), table(spark, sf, "customer")
    events = table(spark, sf, "events").select(F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))
    return quality.report({
        "raw_sales_orders_header": (orders, [quality.not_null(orders, "o_custkey"), quality.unique(orders, ["o_orderkey"])]),
        "raw_iot_telemetry": (events, [quality.not_null(events, "value"), quality.value_range(events, "value", 0, 100)]),
        "cleaned_customers": (customers, [quality.not_null(customers, "c_name")]),
    })


@query("select o_custkey from orders except select case when c_custkey % 3 <> 0 then c_custkey else -c_custkey end as c_custkey from customer")
def orphan_except(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").subtract(table(spark, sf, "customer").select(F.expr("case when c_custkey % 3 <> 0 then c_custkey else -c_custkey end as c_custkey")))


@query("select distinct o_custkey from orders anti join (select case when c_custkey % 3 <> 0 then c_custkey else -c_custkey end as c_custkey from customer) c on o_custkey = c_custkey")
def orphan_anti_join(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct().join(table(spark, sf, "customer").select(F.expr("case when c_custkey % 3 <> 0 then c_custkey else -c_custkey end as c_custkey")), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


_OLD = "select case when c_custkey % 4 <> 0 then c_custkey else -c_custkey end as c_custkey, c_name, c_mktsegment, md5(c_name || c_mktsegment) as row_hash from customer"
_NEW = "select case when c_custkey % 6 <> 0 then c_custkey else -c_custkey end as c_custkey, c_name, case when c_custkey % 5 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment, md5(c_name || case when c_custkey % 5 = 0 then 'MOVED' else c_mktsegment end) as row_hash from customer"


def _versions(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    hashed = lambda df: df.withColumn("row_hash", F.md5(F.concat("c_name", "c_mktsegment")))
    old = scd2.initial(hashed(customers.withColumn("c_custkey", F.expr("case when c_custkey % 4 <> 0 then c_custkey else -c_custkey end"))), "2024-01-01")
    moved = F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment"))
    return old, hashed(customers.withColumn("c_mktsegment", moved).withColumn("c_custkey", F.expr("case when c_custkey % 6 <> 0 then c_custkey else -c_custkey end")))


@query(f"with o as ({_OLD}), n as ({_NEW}) select n.*, case when o.c_custkey is null then 'INSERT' when o.row_hash = n.row_hash then 'SKIP' else 'UPDATE' end as action from n left join o using (c_custkey)")
def scd2_classify(spark, sf):
    return scd2.classify(*_versions(spark, sf), ["c_custkey"])


@query(f"""with o as ({_OLD}), n as ({_NEW}), s as (select n.*, o.c_custkey is null as fresh from n left join o using (c_custkey) where o.c_custkey is null or o.row_hash <> n.row_hash)
select o.*, '2024-01-01' as effective_from, case when s.c_custkey is not null then '2024-02-01' end as effective_to, s.c_custkey is null as is_current from o left join s on o.c_custkey = s.c_custkey
union all select c_custkey, c_name, c_mktsegment, row_hash, '2024-02-01', null, true from s""")
def scd2_merge(spark, sf):
    out = scd2.merge(*_versions(spark, sf), ["c_custkey"], "2024-02-01")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("c_custkey", "c_name", "c_mktsegment", "row_hash", day("_effective_from").alias("effective_from"), day("_effective_to").alias("effective_to"), F.col("_is_current").alias("is_current"))


@query(f"with o as ({_OLD}), n as ({_NEW}), s as (select n.c_custkey, o.c_custkey is not null as old from n left join o using (c_custkey) where o.c_custkey is null or o.row_hash <> n.row_hash) select (select count(*) from o) + count(*) as total, (select count(*) from o) + count(*) filter (where not old) as current, count(*) filter (where old) as historical from s")
def scd2_summary(spark, sf):
    return scd2.summary(scd2.merge(*_versions(spark, sf), ["c_custkey"], "2024-02-01"))


@query(f"select c_custkey, c_name, c_mktsegment, row_hash from ({ORACLE['scd2_merge']}) where is_current")
def scd2_current(spark, sf):
    history = scd2.merge(*_versions(spark, sf), ["c_custkey"], "2024-02-01")
    return scd2.current(history).select("c_custkey", "c_name", "c_mktsegment", "row_hash")


_CHUNKS = "select case when doc_id % 3 <> 0 then doc_id else -doc_id end as doc_id, md5(text) as content_hash from documents"
_FRESH = "select case when doc_id % 5 <> 0 then doc_id else -doc_id end as doc_id, md5(case when doc_id % 4 = 0 then text || '!' else text end) as content_hash from documents"


@query(f"with o as ({_CHUNKS}), n as ({_FRESH}) select n.*, case when o.doc_id is null then 'insert' when o.content_hash = n.content_hash then 'skip' else 'update' end as action from n left join o using (doc_id) union all select o.*, 'keep' from o anti join n using (doc_id)")
def chunk_hash_upsert(spark, sf):
    docs = table(spark, sf, "documents")
    old = docs.select(F.expr("case when doc_id % 3 <> 0 then doc_id else -doc_id end as doc_id"), F.md5("text").alias("content_hash"))
    new = docs.select(F.expr("case when doc_id % 5 <> 0 then doc_id else -doc_id end as doc_id"), F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return writers.upsert(old, new, "doc_id", "content_hash")


@query("select event_id, event_type from events where ts >= timestamp '2024-01-20' - interval 5 days and not (event_type = 'click')")
def stale_cleanup(spark, sf):
    fresh = writers.without_stale(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", datetime(2024, 1, 20), 5)
    return writers.without(fresh, F.col("event_type") == "click").select("event_id", "event_type")


@query("select count(*) filter (where ts < timestamp '2024-01-20' - interval 5 days) as removed, count(*) filter (where ts >= timestamp '2024-01-20' - interval 5 days) as kept from events")
def stale_cleanup_counts(spark, sf):
    return writers.stale_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", datetime(2024, 1, 20), 5)


@query("""select lower(c_name) as customer_name, c_acctbal as balance from customer""")
def serving_load(spark, sf):
    given = table(spark, sf, "customer").select(F.lower("c_name").alias("C Name"), F.col("c_acctbal").alias("C_AcctBal"), "c_nationkey")
    return writers.serving(given, {"c_name": "customer_name", "c_acctbal": "balance"}, ["customer_name", "balance", "unknown"])
