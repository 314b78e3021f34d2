"""Governance and operations: classification, log search, costs, safe SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import sqlguard

#: Own patterns for seven kinds of personal data in texts.
PII = {
    "card": r"\b(?:\d[ -]?){13,16}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "phone": r"(?:\+\d{1,3}[ -]?)?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}",
    "licence": r"\b[A-Z]{1,2}\d{6,8}\b", "passport": r"\b[A-Z]\d{8}\b", "medical_record": r"\bMRN[: ]?\d{6,10}\b",
}
# The classes of columns and the patterns of their names, in any case.
COLUMN_CLASSES = {
    "CUSTOM_CUSTOMER_DATA": [
        "(customer_name|name1|cust_name|account_name)", "(email|smtp_addr|e_mail)", "(phone|telf1|mobile|fax)", "(address|stras|street|mailing_address)",
        "(postal|pstlz|zip_code)", "(city|ort01|ort02)", "(country|land1)",
    ],
    "CUSTOM_FINANCIAL_DATA": [
        "(netwr|net_value|net_amount)", "(amount|revenue|price|total_price)", "(waerk|currency|currency_code)", "(credit_limit|klimk)", "(payment|billing|invoice)", "(annual_revenue|expected_revenue)",
    ],
    "CUSTOM_EMPLOYEE_DATA": ["(employee|emp_id|personnel_number)", "(salary|compensation|benefits)", "(owner_name|created_by|modified_by)"],
    "CUSTOM_MANUFACTURING_IP": ["(recipe|formula|specification)", "(tolerance|process_param)", "(production_secret|proprietary)"],
    "CUSTOM_REGULATORY_DATA": ["(batch_number|charg|lot)", "(serial_number|sernr)", "(quality_check|inspection|compliance)", "(shelf_life|expiration)"],
}
READ_WORDS = {"SELECT", "WITH", "EXPLAIN"}
# Words that must be blocked.
BLOCKED_WORDS = {"INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "COPY", "EXECUTE", "CALL"}
ALSO_BLOCKED = {"MERGE"}


def classify_columns(columns: DataFrame, classes: dict[str, list[str]] = COLUMN_CLASSES) -> DataFrame:
    """(table_name, column_name) with every class whose pattern the name matches."""
    found = F.array_compact(F.array(*(F.when(F.lower("column_name").rlike("|".join(p)), name) for name, p in classes.items())))
    return columns.withColumn("classes", F.array_join(found, ","))


def pii_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Occurrences of each kind; texts with none are left out.

    A pattern runs only on texts that hold what it cannot do without, an @ or a digit.  The counts come
    out of a generator, below which no filter is pushed, so that each pattern runs once on a text.
    """
    text = F.coalesce(text_col, F.lit(""))
    has = {"email": F.contains(text, F.lit("@"))}
    counts = F.struct(*(F.when(has.get(k, text.rlike("[0-9]")), F.regexp_count(text, F.lit(p))).otherwise(0).cast("long").alias(k) for k, p in PII.items()))
    return docs.select(id_col, F.inline(F.array(counts))).where(" + ".join(PII) + " > 0")


def log_search(logs: DataFrame, equals: dict, contains: dict, newest: list, limit: int) -> DataFrame:
    for c, v in equals.items():
        logs = logs.where(F.col(c) == F.lit(v))
    for c, v in contains.items():
        logs = logs.where(F.col(c).contains(v))
    return logs.orderBy(*newest).limit(limit)


def substring_search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows where any column holds the term, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return df.where(hit)


def ticket_search(tickets: DataFrame, term: str, columns: list[str], **equals) -> DataFrame:
    """A search that also narrows by equality; None stands for any value."""
    found = substring_search(tickets, term, columns)
    for c, v in equals.items():
        if v is not None:
            found = found.where(F.col(c) == F.lit(v))
    return found


def status_counts(tickets: DataFrame, status: str, labels: dict[str, str]) -> DataFrame:
    """One row: the number of tickets in each status of ``labels`` (status -> column)."""
    return tickets.agg(F.count("*").alias("tickets"), *(F.count_if(F.col(status) == s).alias(c) for s, c in labels.items()))


def cost_shares(costs: DataFrame, name: str, cost: str, n: int, day: int, days_in_month: int, least: float = 0.001) -> DataFrame:
    """The n largest costs, their share, and the month's projection; crumbs are dropped."""
    sums = costs.groupBy(name).agg(F.sum(cost).alias("cost")).where(F.col("cost") > least)
    whole = Window.partitionBy()
    shared = sums.withColumns({"share_pct": F.round(100 * F.col("cost") / F.sum("cost").over(whole), 4), "projected": F.round(F.col("cost") / day * days_in_month, 4)})
    return shared.orderBy(F.desc("cost"), name).limit(n)


def status_summary(runs: DataFrame, status: str, good: str) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col(status) == good).alias("succeeded"), F.round(100.0 * F.count_if(F.col(status) == good) / F.count("*"), 1).alias("success_pct"))


def runs_by_status(runs: DataFrame, status: str) -> DataFrame:
    """(status, runs, share_pct): how many runs ended in each way."""
    counts = runs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("runs"))
    return counts.withColumn("share_pct", F.round(100.0 * F.col("runs") / F.sum("runs").over(Window.partitionBy()), 1))


def windowed_alert(events: DataFrame, ts: str, value: str, window: str, limit: float) -> DataFrame:
    """Windows whose sum exceeds a limit."""
    sums = events.groupBy(F.window(ts, window)).agg(F.sum(value).alias("total"))
    return sums.where(F.col("total") > limit).select(F.col("window.start").alias("start"), F.round("total", 4).alias("total"))


def top_groups(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def sample_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a hash of their key: the same ones in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def sample_fraction(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """About this part of the rows, chosen by a hash of their key: no shuffle, the same ones in
    every run."""
    return df.where(F.substring(F.md5(F.col(key).cast("string")), 1, 8) < f"{min(int(fraction * 2**32), 2**32 - 1):08x}")


def numbered(df: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """``df`` with ``r``: the place, from 0, in the order of a unique whole-number key; rows
    without a key are left out.

    Keys are numbered within blocks of ``width`` values, and each block starts after the
    keys of those before.  A task holds one block, and the last sum one row per block.
    """
    blocks = df.where(F.col(key).isNotNull()).withColumn("_block", F.expr(f"`{key}` div {width}"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return blocks.withColumn("r", place).join(starts, "_block").withColumn("r", F.col("r") + F.col("_before")).drop("_block", "_before")


def check_sql(text: str) -> str | None:
    """Why a statement is not a plain query by its words alone, or None; ``sqlguard`` looks at its plan."""
    words = re.findall(r"[A-Za-z_]+", re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).upper())
    if not words:
        return "empty statement"
    if words[0] not in READ_WORDS:
        return f"{words[0]} is not a query"
    return next((f"{w} is blocked" for w in words if w in BLOCKED_WORDS | ALSO_BLOCKED), None)


def safe_sql(spark: SparkSession, text: str, max_rows: int = 500) -> DataFrame:
    """The result of one query, up to one row more than ``max_rows`` to show a cut; what may be in it
    is decided on the parsed plan."""
    return sqlguard.guarded(spark, text, max_rows)


def markdown(rows: DataFrame, max_rows: int = 500, width: int = 100) -> str:
    """A short result as a table: nulls are blank, long cells are cut."""
    shown = rows.limit(max_rows + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")[:width]
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in shown[:max_rows]]
    return "\n".join(lines + [f"({max_rows} rows shown)"] * (len(shown) > max_rows))
