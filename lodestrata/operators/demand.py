"""Demand: daily series, rolling features over day ranges, lags, classes, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["material_number", "plant"]


def base(silver: DataFrame, as_of: str, lookback_days: int = 365) -> DataFrame:
    """Accepted orders with all keys in the days before ``as_of``."""
    day = F.lit(as_of).cast("date")
    keys = F.col("material_number").isNotNull() & F.col("plant").isNotNull() & F.col("order_date").isNotNull()
    return silver.where(~F.col("is_rejected") & keys & (F.col("order_date") >= F.date_sub(day, lookback_days)) & (F.col("order_date") <= day))


def daily(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return rows.groupBy(*keys, "order_date").agg(
        F.sum("quantity").cast("double").alias("quantity"), F.sum("net_value").cast("double").alias("revenue"), F.countDistinct("order_number").alias("orders"), F.countDistinct("customer_number").alias("customers")
    )


def days(keys: list[str], before: int):
    """A frame of calendar days: the row's own and those up to ``before`` days earlier."""
    return Window.partitionBy(*keys).orderBy(F.unix_date("order_date")).rangeBetween(-(before - 1), 0)


def rolling(d: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """All frames share one partitioning and order, hence one shuffle and one sort."""
    w7, w30, w90 = (days(keys, n) for n in (7, 30, 90))
    return d.select(
        *keys, "order_date", "quantity",
        F.round(F.avg("quantity").over(w7), 8).alias("avg_7d"), F.round(F.avg("quantity").over(w30), 8).alias("avg_30d"), F.round(F.avg("quantity").over(w90), 8).alias("avg_90d"),
        F.sum("quantity").over(w7).alias("sum_7d"), F.sum("quantity").over(w30).alias("sum_30d"), F.round(F.stddev_samp("quantity").over(w30), 8).alias("std_30d"),
        F.round(F.avg("revenue").over(w30), 8).alias("avg_revenue_30d"), F.round(F.avg("orders").over(w30), 8).alias("avg_orders_30d"),
    )


def lags(d: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The quantity of 1, 7 and 30 rows before, and of exactly 7 calendar days before."""
    w = Window.partitionBy(*keys).orderBy("order_date")
    week_ago = Window.partitionBy(*keys).orderBy(F.unix_date("order_date")).rangeBetween(-7, -7)
    return d.select(*keys, "order_date", "quantity", *(F.lag("quantity", n).over(w).alias(f"lag_{n}") for n in (1, 7, 30)), F.sum("quantity").over(week_ago).alias("week_ago"))


def variability(r: DataFrame) -> DataFrame:
    """Coefficient of variation, trend and the high-variability flag from rolling columns."""
    cv = F.when(F.col("avg_30d") > 0, F.round(F.col("std_30d") / F.col("avg_30d"), 6))
    trend = F.when(F.col("avg_90d") > 0, F.round((F.col("avg_30d") - F.col("avg_90d")) / F.col("avg_90d"), 6)).otherwise(0.0)
    return r.withColumns({"cv_30d": cv, "trend": trend}).withColumn("is_variable", F.coalesce(F.col("cv_30d") > 0.5, F.lit(False)))


def velocity(d: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The average day of the whole lookback, and its class."""
    avg = F.avg("quantity").over(Window.partitionBy(*keys))
    rows = d.withColumn("avg_daily", F.round(avg, 4))
    label = F.when(F.col("avg_daily") >= 100, "A_FAST").when(F.col("avg_daily") >= 10, "B_MEDIUM").when(F.col("avg_daily") >= 1, "C_SLOW").otherwise("D_VERY_SLOW")
    return rows.select(*keys, "order_date", "avg_daily", label.alias("velocity"))


def temporal(d: DataFrame) -> DataFrame:
    c = F.col("order_date")
    day, month = F.dayofmonth(c), F.month(c)
    flags = {
        "day_of_week": F.dayofweek(c), "day_of_month": day, "week": F.weekofyear(c), "month": month, "quarter": F.quarter(c), "is_weekend": F.dayofweek(c).isin(1, 7).cast("int"),
        "is_month_start": (day <= 3).cast("int"), "is_month_end": (day >= 28).cast("int"), "is_quarter_end": (month.isin(3, 6, 9, 12) & (day >= 25)).cast("int"),
    }
    return d.withColumns({k: v.cast("long") for k, v in flags.items()})


def anomalies(d: DataFrame, keys: list[str] = KEY, k: float = 2.0, lookback: int = 90) -> DataFrame:
    """Days further than k standard deviations from the mean of their lookback."""
    w = days(keys, lookback)
    scored = d.withColumns({"mean": F.avg("quantity").over(w), "std": F.stddev_samp("quantity").over(w)})
    return scored.where(F.abs(F.col("quantity") - F.col("mean")) > k * F.col("std") + 1e-9).select(*keys, "order_date", "quantity", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def dense(d: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Every calendar day between a key's first and last, with zero where nothing was sold."""
    ends = d.groupBy(*keys).agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    spine = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("order_date"))
    return spine.join(d, [*keys, "order_date"], "left").fillna(0, subset=["quantity"])
