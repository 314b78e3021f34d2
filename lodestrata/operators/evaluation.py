"""Evaluation results: distributions, pass rates, error and latency bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.equipment import banded

#: Upper bounds (inclusive) and scores.
LATENCY_BANDS = [(1000, 5), (2000, 4), (3000, 3), (5000, 2)]
MAPE_BANDS = [(5, 5), (10, 4), (15, 3), (25, 2)]


BLOCKS = 64  # of a metric's values


def score(c: Column, bands: list[tuple]) -> Column:
    out = F.when(c <= bands[0][0], bands[0][1])
    for bound, points in bands[1:]:
        out = out.when(c <= bound, points)
    return F.when(c.isNotNull(), out.otherwise(1))


def distribution(results: DataFrame, metric: str = "metric", value: str = "score") -> DataFrame:
    """Mean, deviation (0 for one value), extremes, and the values at the positions n/2 and
    0.95 n of the sorted list.

    The positions are taken from value counts.  Approximate quantiles cut a metric's values into
    blocks, which are put in order one by one, so no task holds a metric; the quantiles only say
    where to cut.
    """
    from pyspark.sql.window import Window

    counted = results.where(F.col(value).isNotNull()).groupBy(metric, value).agg(F.count("*").alias("m"))
    cuts = counted.groupBy(F.col(metric).alias("_of")).agg(F.approx_percentile(value, [i / BLOCKS for i in range(1, BLOCKS)]).alias("_cuts"))
    blocks = counted.join(cuts, F.col(metric) == F.col("_of")).select(metric, value, "m", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_block"))
    whole = Window.partitionBy(metric)
    sizes = blocks.groupBy(metric, "_block").agg(F.sum("m").alias("_m"))
    before = F.sum("_m").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(metric, "_block", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("n"))
    within = Window.partitionBy(metric, "_block").orderBy(value)
    upto = blocks.withColumn("_in", F.sum("m").over(within)).join(starts, [metric, "_block"]).withColumn("upto", F.col("_before") + F.col("_in"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    middle, high = F.floor(F.col("n") / 2), F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    places = upto.groupBy(metric).agg(at(middle).alias("p50"), at(high).alias("p95"))
    plain = results.groupBy(metric).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.join(places, metric)


def evaluated(cases: DataFrame, case: str, metrics: dict[str, tuple[Column, float]]) -> DataFrame:
    """(case, metric, score, passed) for metrics given as expressions over a case with the least
    score that passes; all are worked out in one pass, and a missing score fails."""
    if not metrics:
        raise ValueError("no metric is given")
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), c.cast("double").alias("score"), F.coalesce(c >= least, F.lit(False)).alias("passed")) for name, (c, least) in metrics.items()))
    return cases.select(case, F.inline(rows))


def pass_rate(results: DataFrame, case: str, passed: str) -> DataFrame:
    """A case passes if all its metrics do."""
    cases = results.groupBy(case).agg(F.every(passed).alias("ok"))
    return cases.agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"), F.round(100.0 * F.count_if("ok") / F.count("*"), 1).alias("rate"))


def mape(rows: DataFrame, key: str, actual: str, predicted: str, most: float = 20.0) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    error = rows.where(a.isNotNull() & p.isNotNull() & (a != 0)).groupBy(key).agg(F.avg(F.abs(a - p) / F.abs(a) * 100).alias("mape"))
    return error.select(key, F.round("mape", 6).alias("mape"), score(F.col("mape"), MAPE_BANDS).alias("score"), (F.col("mape") <= most).alias("passed"))


def latency(rows: DataFrame, key: str, milliseconds: str, most: float = 5000.0) -> DataFrame:
    c = F.col(milliseconds)
    return rows.select(key, milliseconds, score(c, LATENCY_BANDS).alias("score"), (c <= most).alias("passed"))
