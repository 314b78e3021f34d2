"""Gold: calendar, product and customer dimensions, the sales fact and its KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import sap
from lodestrata.operators.silver import latest


def dim_date(days: DataFrame) -> DataFrame:
    d = F.col("full_date")
    return days.select(
        sap.date_key(d).alias("date_key"), "full_date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day_of_month"), F.dayofweek(d).alias("day_of_week"), F.dayofyear(d).alias("day_of_year"), F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "EEEE").alias("day_name"), sap.fiscal_year(d).alias("fiscal_year"), sap.fiscal_quarter(d).alias("fiscal_quarter"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"), F.date_format(d, "yyyy-MM").alias("year_month"), sap.week_label(d).alias("year_week"),
    )


def dimension(silver: DataFrame, natural: str, attributes: list[str], key: str) -> DataFrame:
    """The attributes of the last order item of each natural key."""
    last = latest(silver.where(F.col(natural).isNotNull()), [natural], [F.desc("order_date"), F.desc("order_number"), F.desc("item_number")])
    return last.select(F.sha2(F.col(natural).cast("string"), 256).alias(key), natural, *attributes)


def fact_sales(silver: DataFrame) -> DataFrame:
    return silver.select(
        "order_item_key", sap.date_key(F.col("order_date")).alias("order_date_key"), sap.date_key(F.col("ship_date")).alias("ship_date_key"),
        F.sha2(F.col("material_number").cast("string"), 256).alias("product_key"), F.sha2(F.col("customer_number").cast("string"), 256).alias("customer_key"),
        "order_number", "item_number", "quantity", "net_value", sap.unit_price(F.col("net_value"), F.col("quantity")).alias("unit_price"), "is_rejected",
    )


def revenue_by(fact: DataFrame, dates: DataFrame, *period: str) -> DataFrame:
    """Accepted revenue and orders per calendar period.  A calendar has some 366 rows a
    year, so its side of the join is small whatever the fact's size."""
    accepted = fact.where(~F.col("is_rejected")).select("order_date_key", "net_value", "order_number")
    joined = accepted.join(dates.select("date_key", *period), F.col("order_date_key") == F.col("date_key"))
    return joined.groupBy(*period).agg(F.sum("net_value").cast("double").alias("revenue"), F.countDistinct("order_number").alias("orders"))


def ranked_total(silver: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with the most accepted revenue."""
    total = silver.where(~F.col("is_rejected")).groupBy(key).agg(F.sum("net_value").cast("double").alias("revenue"), F.sum("quantity").cast("double").alias("quantity"), F.countDistinct("order_number").alias("orders"))
    return total.orderBy(F.desc("revenue"), key).limit(n)


def kpis(silver: DataFrame) -> DataFrame:
    ok = ~F.col("is_rejected")
    revenue = F.sum(F.when(ok, F.col("net_value"))).cast("double")
    orders = F.countDistinct(F.when(ok, F.col("order_number")))
    return silver.agg(
        F.round(revenue, 2).alias("revenue"), orders.alias("orders"), F.round(revenue / orders, 4).alias("average_order_value"),
        F.round(revenue / F.sum(F.when(ok, F.col("quantity"))).cast("double"), 6).alias("average_unit_price"), F.round(100.0 * F.count_if(~ok) / F.count("*"), 4).alias("rejection_rate"),
    )


def concentration(silver: DataFrame, key: str, n: int) -> DataFrame:
    """Share of accepted revenue that the n largest keys bring."""
    total = silver.where(~F.col("is_rejected")).groupBy(key).agg(F.sum("net_value").alias("r"))
    top = total.orderBy(F.desc("r"), key).limit(n).agg(F.sum("r").cast("double").alias("top"))
    return top.crossJoin(total.agg(F.sum("r").cast("double").alias("whole"))).select(F.round(F.col("top"), 2).alias("top_revenue"), F.round(100 * F.col("top") / F.col("whole"), 4).alias("share_pct"))


def trend(silver: DataFrame) -> DataFrame:
    """Accepted revenue by year and month, against the same month one year before."""
    m = silver.where(~F.col("is_rejected")).groupBy(F.year("order_date").cast("long").alias("year"), F.month("order_date").cast("long").alias("month")).agg(F.sum("net_value").cast("double").alias("revenue"))
    before = m.select((F.col("year") + 1).alias("year"), "month", F.col("revenue").alias("prior"))
    return m.join(before, ["year", "month"], "left").select("year", "month", "revenue", "prior", F.round(100 * (F.col("revenue") - F.col("prior")) / F.col("prior"), 4).alias("yoy_pct"))


def period_start(as_of: Column, period: str) -> Column:
    """First day of mtd, qtd or ytd, or of the last 30 or 90 days."""
    if period in ("30d", "90d"):
        return F.date_sub(as_of, int(period[:-1]) - 1)
    return F.trunc(as_of, {"mtd": "month", "qtd": "quarter", "ytd": "year"}[period])


def period_kpis(silver: DataFrame, as_of: Column, periods: tuple[str, ...] = ("mtd", "qtd", "ytd", "30d", "90d")) -> DataFrame:
    """All periods in one pass over the orders."""
    ok = ~F.col("is_rejected") & (F.col("order_date") <= as_of)
    sums = [x for p in periods for x in (F.sum(F.when(ok & (F.col("order_date") >= period_start(as_of, p)), F.col("net_value"))).cast("double").alias(f"revenue_{p}"), F.countDistinct(F.when(ok & (F.col("order_date") >= period_start(as_of, p)), F.col("order_number"))).alias(f"orders_{p}"))]
    return silver.agg(*sums)


def fill_rate(silver: DataFrame, promised_days: int) -> DataFrame:
    """Share of accepted orders whose last item shipped within the promised days."""
    orders = silver.where(~F.col("is_rejected")).groupBy("order_number").agg(F.min("order_date").alias("ordered"), F.max("ship_date").alias("shipped"))
    on_time = F.coalesce(F.col("shipped") <= F.date_add("ordered", promised_days), F.lit(False))
    counts = orders.agg(F.count("*").alias("orders"), F.count_if(on_time).alias("on_time"))
    return counts.withColumn("fill_rate", F.when(F.col("orders") > 0, F.round(F.col("on_time") / F.col("orders"), 6)))


def prior_span(start: str, end: str, compare_with: str) -> tuple[Column, Column]:
    """The span of as many days just before, or the same days of the year before."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if compare_with == "previous_period":
        return F.date_sub(first, F.datediff(last, first) + 1), F.date_sub(first, 1)
    if compare_with == "same_period_last_year":
        return F.add_months(first, -12), F.add_months(last, -12)
    raise ValueError(f"cannot compare with {compare_with!r}")


def compared(silver: DataFrame, start: str, end: str, compare_with: str) -> DataFrame:
    """Accepted revenue and orders of a span and of an earlier one, in one pass over both."""
    first, last = prior_span(start, end, compare_with)
    now, before = F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("order_date").between(first, last)
    rows = silver.where(~F.col("is_rejected") & (now | before))
    total = lambda span: F.coalesce(F.sum(F.when(span, F.col("net_value"))), F.lit(0)).cast("double")
    count = lambda span: F.countDistinct(F.when(span, F.col("order_number")))
    sums = rows.agg(total(now).alias("revenue"), total(before).alias("prior_revenue"), count(now).alias("orders"), count(before).alias("prior_orders"))
    return sums.withColumn("change_pct", F.when(F.col("prior_revenue") > 0, F.round(100 * (F.col("revenue") - F.col("prior_revenue")) / F.col("prior_revenue"), 4)))


#: Areas of a summary that rank something, and the column they rank.
RANKED_AREAS = {"products": "material_number", "customers": "customer_number", "regions": "plant"}


def executive_summary(silver: DataFrame, start: str, end: str, focus: tuple[str, ...] = ("revenue", "volume", "products"), n: int = 3) -> DataFrame:
    """(area, rank, name, value) of the wanted areas over a span: totals, the n best of each
    ranked area by accepted revenue, or the percentage of rejected items."""
    accepted = ~F.col("is_rejected")
    totals = {
        "revenue": F.sum(F.when(accepted, F.col("net_value"))).cast("double"), "volume": F.sum(F.when(accepted, F.col("quantity"))).cast("double"),
        "rejections": F.round(100.0 * F.count_if("is_rejected") / F.count("*"), 4),
    }
    if unknown := set(focus) - set(totals) - set(RANKED_AREAS):
        raise ValueError(f"unknown areas: {', '.join(sorted(unknown))}")
    if not focus:
        raise ValueError("no area is wanted")
    rows = silver.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    parts = []
    if single := [a for a in focus if a in totals]:
        cells = F.array(*(F.struct(F.lit(a).alias("area"), F.lit(1).alias("rank"), F.lit("total").alias("name"), F.col(a).alias("value")) for a in single))
        parts.append(rows.agg(*(totals[a].alias(a) for a in single)).select(F.inline(cells)))
    for area in (a for a in focus if a in RANKED_AREAS):
        best = ranked_total(rows, RANKED_AREAS[area], n)
        order = Window.orderBy(F.desc("revenue"), RANKED_AREAS[area])
        parts.append(best.select(F.lit(area).alias("area"), F.row_number().over(order).alias("rank"), F.col(RANKED_AREAS[area]).cast("string").alias("name"), F.col("revenue").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def sales_query(silver: DataFrame, kind: str, start: str, end: str, filters: dict | None = None, n: int = 10) -> DataFrame:
    """The named sales reports over a span of order dates, with optional equality filters."""
    rows = silver.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for column, value in (filters or {}).items():
        rows = rows.where(F.col(column) == F.lit(value))
    reports = {
        "revenue_summary": kpis,
        "top_products": lambda r: ranked_total(r, "material_number", n),
        "top_customers": lambda r: ranked_total(r, "customer_number", n),
        "sales_trend": trend,
        "order_analysis": lambda r: r.groupBy("order_type").agg(F.countDistinct("order_number").alias("orders"), F.sum("net_value").cast("double").alias("value")),
        "rejection_analysis": rejections,
    }
    if kind not in reports:
        raise ValueError(f"no report {kind!r}; there are {', '.join(sorted(reports))}")
    return reports[kind](rows)


def rejections(silver: DataFrame) -> DataFrame:
    return silver.groupBy("order_type").agg(
        F.count_if("is_rejected").alias("rejected"), F.count("*").alias("items"), F.round(100.0 * F.count_if("is_rejected") / F.count("*"), 4).alias("rate"),
        F.coalesce(F.sum(F.when(F.col("is_rejected"), F.col("net_value"))).cast("double"), F.lit(0.0)).alias("rejected_value"),
    )


def monthly_metrics(silver: DataFrame) -> DataFrame:
    """Per product, plant and month; rejected lines count into revenue here."""
    price = sap.unit_price(F.col("net_value"), F.col("quantity"))
    return silver.groupBy("material_number", "plant", F.trunc("order_date", "month").alias("month_start")).agg(
        F.sum("quantity").cast("double").alias("quantity"), F.sum("net_value").cast("double").alias("revenue"), F.count("*").alias("lines"), F.countDistinct("order_number").alias("orders"),
        F.countDistinct("customer_number").alias("customers"), F.round(F.avg(price).cast("double"), 4).alias("avg_price"), F.min(price).cast("double").alias("min_price"), F.max(price).cast("double").alias("max_price"),
        F.count_if("is_rejected").alias("rejected_lines"), F.coalesce(F.sum(F.when(F.col("is_rejected"), F.col("net_value"))).cast("double"), F.lit(0.0)).alias("rejected_value"),
    )


def with_yoy(metrics: DataFrame) -> DataFrame:
    """Revenue of the same month in the last year that has one."""
    w = Window.partitionBy("material_number", "plant", F.month("month_start")).orderBy("month_start")
    prior = F.lag("revenue").over(w)
    return metrics.withColumn("prior_revenue", prior).withColumn("yoy_pct", F.when(F.col("prior_revenue") > 0, F.round(100 * (F.col("revenue") - F.col("prior_revenue")) / F.col("prior_revenue"), 4)))
