"""Silver: the latest version of each item, joined to its header and typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total to be repeatable.

    Ranking with a limit of one is pushed below the shuffle, so each task sends at most
    a row per key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def trimmed(df: DataFrame) -> DataFrame:
    """Every text column without blanks at either end."""
    return df.select(*(F.trim(c).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def latest_items(lineitem: DataFrame) -> DataFrame:
    """Dealt by order before they are ranked, as an item has few versions: no task sorts all that
    it reads, and the join with the headers finds its rows in place."""
    return latest(lineitem.repartition("l_orderkey"), ["l_orderkey", "l_linenumber"], [F.desc(c) for c in LINE_ORDER])


def orders(items: DataFrame, headers: DataFrame) -> DataFrame:
    """The latest items with their headers, in the names and types of the silver layer;
    a number that does not fit its type is null."""
    joined = latest_items(items).join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.sha2(F.concat_ws("||", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), 256).alias("order_item_key"),
        F.col("l_orderkey").alias("order_number"), F.col("l_linenumber").alias("item_number"), F.col("o_custkey").alias("customer_number"), F.col("l_partkey").alias("material_number"),
        F.col("l_suppkey").alias("plant"), F.col("o_orderpriority").alias("order_type"), F.col("l_quantity").try_cast("decimal(18,3)").alias("quantity"),
        F.col("l_extendedprice").try_cast("decimal(18,2)").alias("net_value"), F.col("o_totalprice").try_cast("decimal(18,2)").alias("header_value"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("l_shipdate").cast("date").alias("ship_date"), F.col("o_orderstatus").alias("status"),
        (F.col("l_returnflag") == "R").alias("is_rejected"),
    )
