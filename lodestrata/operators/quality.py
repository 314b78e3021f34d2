"""Data-quality checks: all counts of a table are taken in one pass."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed thresholds: highest share of failing rows, or lowest integrity.
THRESHOLDS = {"not_null": 0.05, "unique": 0.01, "value_range": 0.02, "date_validity": 0.02, "referential_integrity": 0.95}
#: Thresholds of single tables.
TABLE_THRESHOLDS = {
    "raw_iot_telemetry": {"not_null": 0.10}, "raw_sales_orders_header": {"not_null": 0.02, "unique": 0.005},
    "cleaned_sales_orders": {"not_null": 0.01, "unique": 0.0}, "agg_demand_forecast": {"not_null": 0.15},
}
RESULT = "check_name string, column_name string, severity string, failed long, total long, rate double, passed boolean"


@dataclass(frozen=True)
class Check:
    """One check; ``failed`` and ``total`` are aggregates over the table."""

    name: str
    column: str
    severity: str
    failed: Column
    total: Column
    threshold: float


def not_null(df: DataFrame, column: str, severity: str = "critical", threshold: float | None = None) -> Check:
    """A column that the table lacks fails for every row."""
    bad = F.count_if(F.col(column).isNull()) if column in df.columns else F.count("*")
    return Check("not_null", column, severity, bad, F.count("*"), THRESHOLDS["not_null"] if threshold is None else threshold)


def unique(df: DataFrame, columns: list[str], severity: str = "critical", threshold: float | None = None) -> Check:
    distinct = F.count_distinct(F.struct(*columns))
    return Check("unique", ",".join(columns), severity, F.count("*") - distinct, F.count("*"), THRESHOLDS["unique"] if threshold is None else threshold)


def value_range(df: DataFrame, column: str, low=None, high=None, severity: str = "warning") -> Check:
    """Fails outside either bound."""
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return Check("value_range", column, severity, F.count_if(F.coalesce(bad, F.lit(False))), F.count("*"), THRESHOLDS["value_range"])


def date_validity(df: DataFrame, column: str, low: str = "2000-01-01", high: str = "2030-12-31", severity: str = "warning") -> Check:
    c = F.col(column)
    return Check("date_validity", column, severity, F.count_if((c < F.lit(low).cast("date")) | (c > F.lit(high).cast("date"))), F.count(c), THRESHOLDS["date_validity"])


def run(df: DataFrame, checks: list[Check]) -> DataFrame:
    """A row per check, from a single aggregation of ``df``."""
    sums = df.agg(*(x.alias(f"{side}{i}") for i, c in enumerate(checks) for side, x in (("f", c.failed), ("t", c.total))))
    rows = []
    for i, c in enumerate(checks):
        rate = F.when(F.col(f"t{i}") > 0, F.col(f"f{i}") / F.col(f"t{i}")).otherwise(0.0)
        rows.append(
            F.struct(
                F.lit(c.name).alias("check_name"), F.lit(c.column).alias("column_name"), F.lit(c.severity).alias("severity"), F.col(f"f{i}").alias("failed"), F.col(f"t{i}").alias("total"),
                F.round(rate, 6).alias("rate"), (rate <= c.threshold).alias("passed"),
            )
        )
    return sums.select(F.inline(F.array(*rows)))


def report(tables: dict[str, tuple[DataFrame, list[Check]]], overrides: dict[str, dict[str, float]] = TABLE_THRESHOLDS) -> DataFrame:
    """The checks of several tables, each table read once, with the thresholds of its own where
    it has some, and whether the whole run passed: no critical check failed."""
    results = []
    for name, (df, checks) in tables.items():
        own = overrides.get(name, {})
        tuned = [replace(c, threshold=own.get(c.name, c.threshold)) for c in checks]
        results.append(run(df, tuned).select(F.lit(name).alias("table_name"), "*"))
    critical_failure = (F.col("severity") == "critical") & ~F.col("passed")
    return reduce(DataFrame.unionByName, results).withColumn("run_passed", ~F.bool_or(critical_failure).over(Window.partitionBy()))


def referential_integrity(child: DataFrame, key: str, parent: DataFrame, parent_key: str, threshold: float | None = None) -> DataFrame:
    """Share of distinct keys (null is one) that the parent has."""
    keys = child.select(F.col(key).alias("k")).distinct()
    orphans = keys.subtract(parent.select(F.col(parent_key).alias("k")))
    counts = keys.agg(F.count("*").alias("total")).crossJoin(orphans.agg(F.count("*").alias("failed")))
    rate = F.when(F.col("total") > 0, 1 - F.col("failed") / F.col("total")).otherwise(1.0)
    least = THRESHOLDS["referential_integrity"] if threshold is None else threshold
    return counts.select(
        F.lit("referential_integrity").alias("check_name"), F.lit(key).alias("column_name"), F.lit("critical").alias("severity"), "failed", "total", F.round(rate, 6).alias("rate"), (rate >= least).alias("passed")
    )


def row_count_change(now: DataFrame, previous_rows: int, most_change: float = 0.5) -> DataFrame:
    change = F.abs(F.count("*") - previous_rows) / F.lit(max(previous_rows, 1))
    return now.agg(F.count("*").alias("rows"), change.alias("change"), (change <= most_change).alias("passed"))


def freshness(df: DataFrame, column: str, as_of, hours: float) -> DataFrame:
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.max(F.col(column)).cast("timestamp"))) / 3600
    return df.agg(F.round(age, 4).alias("age_hours"), (age <= hours).alias("passed"))


def gate(results: DataFrame) -> None:
    """Raises if a critical check failed; a results table has a row per check."""
    bad = results.where("severity = 'critical' and not passed").collect()
    if bad:
        raise ValueError("critical checks failed: " + ", ".join(f"{r.check_name}({r.column_name})" for r in bad))
