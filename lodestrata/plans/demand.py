"""Queries over daily demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import demand
from lodestrata.plans.registry import SILVER_SQL, query, silver_orders

AS_OF = "2001-08-01"
_DAILY = f"""
with {SILVER_SQL},
daily as (
  select material_number, plant, order_date, cast(sum(quantity) as double) as quantity, cast(sum(net_value) as double) as revenue, count(distinct order_number) as orders, count(distinct customer_number) as customers
  from silver where not is_rejected and material_number is not null and plant is not null and order_date between date '{AS_OF}' - 365 and date '{AS_OF}' group by 1, 2, 3
),
byday as (
  select plant, order_date, cast(sum(quantity) as double) as quantity, cast(sum(net_value) as double) as revenue, count(distinct order_number) as orders, count(distinct customer_number) as customers
  from silver where not is_rejected and material_number is not null and plant is not null and order_date between date '{AS_OF}' - 365 and date '{AS_OF}' group by 1, 2
)
"""
_W = "over (partition by plant order by order_date range between interval {} days preceding and current row)"
_ROLL = ", rolling as (select plant, order_date, quantity, " + ", ".join(
    [
        *(f"round(avg(quantity) {_W.format(n - 1)}, 8) as avg_{n}d" for n in (7, 30, 90)), *(f"sum(quantity) {_W.format(n - 1)} as sum_{n}d" for n in (7, 30)),
        f"round(stddev_samp(quantity) {_W.format(29)}, 8) as std_30d", f"round(avg(revenue) {_W.format(29)}, 8) as avg_revenue_30d", f"round(avg(orders) {_W.format(29)}, 8) as avg_orders_30d",
    ]
) + " from byday)"
PLANT = ["plant"]


def _rows(spark, sf):
    return demand.base(silver_orders(spark, sf), AS_OF)


@query(_DAILY + "select * from daily")
def daily_demand(spark, sf):
    return demand.daily(_rows(spark, sf))


@query(_DAILY + _ROLL + "select * from rolling")
def rolling_7_30_90(spark, sf):
    return demand.rolling(demand.daily(_rows(spark, sf), PLANT), PLANT)


@query(_DAILY + """select plant, order_date, quantity, lag(quantity, 1) over w as lag_1, lag(quantity, 7) over w as lag_7, lag(quantity, 30) over w as lag_30,
sum(quantity) over (partition by plant order by order_date range between interval 7 days preceding and interval 7 days preceding) as week_ago from byday window w as (partition by plant order by order_date)""")
def lag_features(spark, sf):
    return demand.lags(demand.daily(_rows(spark, sf), PLANT), PLANT)


@query(_DAILY + _ROLL + """, v as (select *, case when avg_30d > 0 then round(std_30d / avg_30d, 6) end as cv_30d, case when avg_90d > 0 then round((avg_30d - avg_90d) / avg_90d, 6) else 0.0 end as trend from rolling)
select plant, order_date, cv_30d, trend, coalesce(cv_30d > 0.5, false) as is_variable from v""")
def demand_cv_trend(spark, sf):
    return demand.variability(demand.rolling(demand.daily(_rows(spark, sf), PLANT), PLANT)).select("plant", "order_date", "cv_30d", "trend", "is_variable")


@query(_DAILY + """, a as (select material_number, plant, order_date, round(avg(quantity) over (partition by material_number, plant), 4) as avg_daily from daily)
select *, case when avg_daily >= 100 then 'A_FAST' when avg_daily >= 10 then 'B_MEDIUM' when avg_daily >= 1 then 'C_SLOW' else 'D_VERY_SLOW' end as velocity from a""")
def product_velocity(spark, sf):
    return demand.velocity(demand.daily(_rows(spark, sf)))


@query(_DAILY + """select plant, order_date, quantity, cast(dayofweek(order_date) + 1 as bigint) as day_of_week, cast(day(order_date) as bigint) as day_of_month, cast(week(order_date) as bigint) as week,
cast(month(order_date) as bigint) as month, cast(quarter(order_date) as bigint) as quarter, cast(dayofweek(order_date) in (0, 6) as bigint) as is_weekend, cast(day(order_date) <= 3 as bigint) as is_month_start,
cast(day(order_date) >= 28 as bigint) as is_month_end, cast(month(order_date) in (3, 6, 9, 12) and day(order_date) >= 25 as bigint) as is_quarter_end from byday""")
def temporal_features(spark, sf):
    return demand.temporal(demand.daily(_rows(spark, sf), PLANT).select("plant", "order_date", "quantity"))


@query(_DAILY + f""", s as (select plant, order_date, quantity, avg(quantity) {_W.format(89)} as mean, stddev_samp(quantity) {_W.format(89)} as std from byday)
select plant, order_date, quantity, round(mean, 4) as mean, round(std, 4) as std from s where abs(quantity - mean) > 2.0 * std + 1e-9""")
def demand_anomalies(spark, sf):
    return demand.anomalies(demand.daily(_rows(spark, sf), PLANT), PLANT)


@query(_DAILY + """, e as (select plant, min(order_date) as a, max(order_date) as b from byday group by 1), s as (select plant, cast(unnest(generate_series(a, b, interval 1 day)) as date) as order_date from e)
select plant, order_date, coalesce(quantity, 0.0) as quantity from s left join byday using (plant, order_date)""")
def calendar_dense_demand(spark, sf):
    return demand.dense(demand.daily(_rows(spark, sf), PLANT).select("plant", "order_date", "quantity"), PLANT)
