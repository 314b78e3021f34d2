"""Customer, order and equipment summaries, and the documents made from them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import equipment
from lodestrata.operators.silver import top_n


def order_summary(orders: DataFrame, key: str = "o_custkey") -> DataFrame:
    total = F.col("o_totalprice").cast("decimal(18,2)")
    return orders.groupBy(key).agg(
        F.count("*").alias("orders"), F.sum(total).cast("double").alias("total"), F.round(F.avg(F.col("o_totalprice")), 8).alias("average"), F.min("o_orderdate").cast("date").alias("first_order"), F.max("o_orderdate").cast("date").alias("last_order")
    )


def product_share(rows: DataFrame, customer: str, product: str, value: str, n: int) -> DataFrame:
    """Each customer's n products with the most revenue, and their share of it all."""
    sums = rows.groupBy(customer, product).agg(F.sum(value).cast("double").alias("revenue"))
    shared = sums.withColumn("share_pct", F.round(100 * F.col("revenue") / F.sum("revenue").over(Window.partitionBy(customer)), 4))
    return top_n(shared, [customer], [F.desc("revenue"), F.col(product)], n)


def year_on_year(orders: DataFrame, key: str, date_col: str, value: str, cut: str) -> DataFrame:
    """Sums before and from a date, the change, and an arrow for its direction."""
    day = F.lit(cut).cast("date")
    d, v = F.col(date_col).cast("date"), F.col(value).cast("decimal(18,2)")
    sums = orders.groupBy(key).agg(F.coalesce(F.sum(F.when(d < day, v)), F.lit(0)).cast("double").alias("before"), F.coalesce(F.sum(F.when(d >= day, v)), F.lit(0)).cast("double").alias("since"))
    change = F.when(F.col("before") > 0, F.round(100 * (F.col("since") - F.col("before")) / F.col("before"), 4))
    return sums.withColumn("change_pct", change).withColumn("arrow", F.when(F.col("change_pct") > 0, "up").when(F.col("change_pct") < 0, "down").otherwise("flat"))


def opportunity_rollup(rows: DataFrame, key: str, stage: str, value: str, won: str, lost: str) -> DataFrame:
    s = F.col(stage)
    n_won, n_lost = F.count_if(s == won), F.count_if(s == lost)
    worth = lambda of: F.coalesce(F.sum(F.when(of, F.col(value).cast("decimal(18,2)"))), F.lit(0)).cast("double")
    return rows.groupBy(key).agg(
        F.count_if(~s.isin(won, lost)).alias("open"), n_won.alias("won"), n_lost.alias("lost"),
        worth(~s.isin(won, lost)).alias("open_value"), worth(s == won).alias("won_value"), worth(s == lost).alias("lost_value"),
        F.when(n_won + n_lost > 0, F.round(100.0 * n_won / (n_won + n_lost), 1)).alias("win_rate"),
    )


def case_rollup(rows: DataFrame, key: str, kind: str, is_open: Column, is_urgent: Column, n: int = 3) -> DataFrame:
    """Counts of cases, and the n most frequent kinds with theirs."""
    counts = rows.groupBy(key).agg(F.count("*").alias("cases"), F.count_if(is_open).alias("open"), F.count_if(is_open & is_urgent).alias("open_urgent"))
    kinds = top_n(rows.groupBy(key, kind).agg(F.count("*").alias("n")), [key], [F.desc("n"), F.col(kind)], n)
    text = kinds.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", kind, "n"))), lambda s: F.concat(s[kind], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ").alias("top_kinds"))
    return counts.join(text, key)


def order_status(orders: DataFrame, billed: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    b, d = billed.select(key).distinct().withColumn("_b", F.lit(True)), delivered.select(key).distinct().withColumn("_d", F.lit(True))
    is_b, is_d = F.coalesce("_b", F.lit(False)), F.coalesce("_d", F.lit(False))
    label = F.when(is_d & is_b, "Delivered and Billed").when(is_d, "Delivered, Pending Billing").when(is_b, "Billed, Pending Delivery").otherwise("Open")
    return orders.join(b, key, "left").join(d, key, "left").withColumn("lifecycle", label).drop("_b", "_d")


def significant(orders: DataFrame, value: str, least: float, date_col: str, as_of: str, days: int = 180) -> DataFrame:
    """Large or recent orders: one filter stands for the union without its duplicates."""
    return orders.where((F.col(value) > least) | (F.col(date_col).cast("date") >= F.date_sub(F.lit(as_of).cast("date"), days)))


def sectioned(heads: DataFrame, key: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(key, text): the head of each key and its sections, each a title and its lines in order.

    ``heads`` are (key, head); a section has rows of (key, place, line), the few of each key that are
    to be shown.  All lines meet in one grouping; a section without lines is left out.
    """
    own = [rows.select(F.col(key).alias("_key"), F.lit(n).alias("n"), F.col("place").cast("int").alias("place"), "line") for n, rows in enumerate(sections.values())]
    entries = reduce(DataFrame.unionByName, own).where("line is not null").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("n", "place", "line"))).alias("entries"))

    def section(n: int, title: str):
        lines = F.transform(F.filter("entries", lambda e: e["n"] == n), lambda e: e["line"])
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(lines, "\n")))

    text = F.concat_ws("\n\n", "head", *(section(n, title) for n, title in enumerate(sections)))
    return heads.join(entries, F.col(key) == F.col("_key"), "left").select(key, text.alias("text"))


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded from the exact value of the double as C does;
    Java's ``%.nf`` rounds the shortest decimal that stands for it, so 0.15 becomes 0.2."""
    d = value.cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(finite, F.call_function("format_number", d, F.lit("0." + "0" * places))).otherwise(d.cast("string"))


def said(form: str, *columns: str | Column) -> Column:
    """The columns in a text; none where any of them is missing."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    places = re.findall(r"%(?:\.(\d+)f|[ds])", form.replace("%%", ""))
    shown = [fixed(v, int(n)) if n else v for v, n in zip(values, places, strict=True)]
    return F.when(reduce(lambda a, b: a & b, (v.isNotNull() for v in values)), F.format_string(re.sub(r"%\.\d+f", "%s", form), *shown))


def customer_sections(orders: DataFrame, products: DataFrame, trend: DataFrame, opportunities: DataFrame, cases: DataFrame, contacts: DataFrame, as_of: str, days: int = 180, recent: int = 8) -> dict[str, DataFrame]:
    """The sections of a customer's document, each from its own view; all have ``customer``."""
    say = lambda df, key, form, *columns, place="1": df.select(F.col(key).alias("customer"), F.expr(place).alias("place"), said(form, *columns).alias("line"))
    day, customer = F.col("o_orderdate").cast("date"), F.col("o_custkey").alias("customer")
    late = orders.where(day >= F.date_sub(F.lit(as_of).cast("date"), days))
    newest = top_n(late, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], recent)
    won = say(opportunities, "o_custkey", "Open: %d (%.2f), won: %d (%.2f), lost: %d (%.2f)", "open", "open_value", "won", "won_value", "lost", "lost_value")
    rate = say(opportunities.where("win_rate is not null"), "o_custkey", "Win rate: %.1f%%", "win_rate", place="2")
    counts = say(cases, "user_id", "Cases: %d, open: %d, urgent: %d", "cases", "open", "open_urgent")
    return {
        "Orders": say(order_summary(orders), "o_custkey", "%d orders, total %.2f, from %s to %s", "orders", "total", F.col("first_order").cast("string"), F.col("last_order").cast("string")),
        "Products": say(products, "customer_number", "%d. material %d: %.2f", "rank", "material_number", "revenue", place="rank"),
        "Order Trend": trend.select(customer, F.lit(1).alias("place"), F.concat(F.lit("Trend: "), F.col("arrow"), F.coalesce(said(" (%.1f%%)", "change_pct"), F.lit(""))).alias("line")),
        "Recent Orders": newest.select(customer, F.col("rank").alias("place"), said("- order %d on %s: %.2f", "o_orderkey", day.cast("string"), "o_totalprice").alias("line")),
        "Pipeline": won.unionByName(rate),
        "Support History": counts.unionByName(say(cases, "user_id", "Most frequent: %s", "top_kinds", place="2")),
        "Key Contacts": say(contacts, "customer", "- %s", "contact", place="rank"),
    }


def customer_documents(customers: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, text): a section is left out where there is nothing to say."""
    heads = customers.select(F.col("c_custkey").alias("customer"), F.concat(F.lit("# "), F.col("c_name"), F.lit("\nSegment: "), F.col("c_mktsegment")).alias("head"))
    return sectioned(heads, "customer", sections).select(F.concat(F.lit("customer_"), F.col("customer").cast("string")).alias("doc_id"), "text")


def order_documents(items: DataFrame) -> DataFrame:
    """(doc_id, body): one JSON document per order with its lines nested; amounts keep their scale."""
    line = F.struct("item_number", "material_number", "quantity", "net_value")
    header = F.struct("customer_number", "order_date", "header_value")
    nested = items.groupBy("order_number").agg(F.first(header).alias("h"), F.array_sort(F.collect_list(line)).alias("lines"))
    return nested.select(F.concat(F.lit("order_"), F.col("order_number").cast("string")).alias("doc_id"), F.to_json(F.struct("order_number", "h.*", "lines")).alias("body"))


def equipment_sections(readings: DataFrame, events: DataFrame, ranges: DataFrame, shown: int = 5) -> dict[str, DataFrame]:
    """The sections of an equipment's document: latest readings with their status, trends, the
    newest readings of bad quality, and the newest events that matter."""
    say = lambda df, place, form, *columns: df.select("equipment_id", F.expr(place).alias("place"), said(form, *columns).alias("line"))
    at = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("equipment_id").orderBy("sensor")))
    bad = top_n(readings.where("quality <> 'GOOD'"), ["equipment_id"], [F.desc("ts"), F.desc("event_id")], shown)
    last = top_n(events.where("kind <> 'none'"), ["equipment_id"], [F.desc("event_ts"), F.col("kind"), F.col("state_to")], shown)
    return {
        "Current Sensor Readings": say(at(equipment.sensor_status(equipment.latest_readings(readings), ranges)), "place", "- %s: %.2f (normal %.1f-%.1f) %s", "sensor", "value", "low", "high", "status"),
        "Sensors": say(at(equipment.split_half_trend(readings)), "place", "- %s: %.6f (%s)", "sensor", "second", "trend"),
        "Anomaly History": say(bad, "rank", "- %s %s %.2f %s", F.col("ts").cast("date").cast("string"), "sensor", "value", "quality"),
        "Maintenance History": say(last, "rank", "- %s %s: %s", F.col("event_ts").cast("date").cast("string"), "kind", "state_to"),
    }


def equipment_documents(health: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, text) from (equipment_id, score, label) and the sections."""
    heads = health.select("equipment_id", F.format_string("# Equipment %d\nHealth Score: %d/100 (%s)", "equipment_id", "score", "label").alias("head"))
    return sectioned(heads, "equipment_id", sections).select(F.concat(F.lit("equipment_"), F.col("equipment_id").cast("string")).alias("doc_id"), "text")


#: What documents say of each group of products; a group that is not here has the last one's.
PRODUCT_GROUPS = {
    "ECONOMY": (["general assembly", "spare parts"], "basic finish"), "STANDARD": (["series production", "maintenance"], "standard finish"), "PROMO": (["samples", "trade fairs"], "printed finish"),
    "SMALL": (["fine mechanics", "sensors", "housings"], "tolerance class fine"), "LARGE": (["presses", "conveyors"], "tolerance class coarse"), "": (["general use"], "standard finish"),
}


def product_documents(parts: DataFrame) -> DataFrame:
    """(doc_id, body): a JSON document with what its group's template adds."""
    pick = lambda of: reduce(lambda out, g: out.when(F.col("p_type") == g, of(*PRODUCT_GROUPS[g])), [g for g in PRODUCT_GROUPS if g], F).otherwise(of(*PRODUCT_GROUPS[""]))
    uses, finish = pick(lambda uses, _: F.array(*map(F.lit, uses))), pick(lambda _, finish: F.lit(finish))
    about = F.concat(F.col("p_name"), F.lit(" is used in "), F.array_join(uses, ", "), F.lit(", with "), finish, F.lit("."))
    spec = F.struct(
        F.col("p_partkey").alias("material"), F.col("p_name").alias("name"), F.col("p_brand").alias("group"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"), about.alias("description"), uses.alias("applications"), finish.alias("finish"),
    )
    return parts.select(F.concat(F.lit("product_"), F.col("p_partkey").cast("string")).alias("doc_id"), F.to_json(spec).alias("body"))
