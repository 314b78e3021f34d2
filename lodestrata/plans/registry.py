"""Registers a query under its function's name, next to its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import silver
from lodestrata.sources.readers import table

QUERIES: dict = {}
ORACLE: dict = {}

#: The silver orders, as DuckDB sees them.
SILVER_SQL = """
items as (
  select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc,
    l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) = 1
),
silver as (
  select sha256(concat_ws('||', cast(l_orderkey as varchar), cast(l_linenumber as varchar))) as order_item_key,
    l_orderkey as order_number, l_linenumber as item_number, o_custkey as customer_number, l_partkey as material_number, l_suppkey as plant,
    o_orderpriority as order_type, cast(l_quantity as decimal(18,3)) as quantity, cast(l_extendedprice as decimal(18,2)) as net_value,
    cast(o_totalprice as decimal(18,2)) as header_value, cast(o_orderdate as date) as order_date, cast(l_shipdate as date) as ship_date,
    o_orderstatus as status, l_returnflag = 'R' as is_rejected
  from items join orders on l_orderkey = o_orderkey
)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def silver_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.orders(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
