"""Equipment: weekly sensor features, labels, states, scores, and the lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators.silver import top_n

#: Named health scales as (upper bound, label), the last without bound.
HEALTH_SCALES = {
    "documents": [(25, "Critical"), (50, "Warning"), (75, "Good"), (None, "Excellent")],
    "agent": [(20, "Critical"), (40, "Poor"), (60, "Fair"), (80, "Good"), (None, "Excellent")],
}
#: The normal range of each sensor.
SENSOR_RANGES = [("temperature", 20.0, 60.0), ("pressure", 2.0, 10.0), ("vibration", 0.5, 8.0), ("humidity", 30.0, 70.0), ("flow_rate", 5.0, 40.0), ("power_consumption", 50.0, 300.0)]
#: Severity of lifecycle events, health weight and action of each risk.
SEVERITY = {"failure": 3, "maintenance_start": 3, "critical": 3, "warning": 2, "degradation_start": 1}
RISKS = ["Low", "Medium", "High", "Critical"]
WEIGHTS = {"Low": 100, "Medium": 70, "High": 30, "Critical": 0}
ACTIONS = {
    "Low": "Continue routine monitoring", "Medium": "Schedule inspection within 60 days", "High": "Plan maintenance within 2 weeks", "Critical": "Immediate maintenance required",
}
#: Upper bound of the failure probability, and remaining days (low, high).
REMAINING = [(0.2, 180, 365), (0.4, 90, 180), (0.6, 30, 90), (0.8, 7, 30), (None, 1, 7)]
STATISTICS = ("mean", "std", "min", "max", "range", "trend")


def banded(c: Column, bands: list[tuple]) -> Column:
    """The label of the first band whose upper bound lies above the value."""
    out = None
    for bound, label in bands[:-1]:
        out = F.when(c < bound, label) if out is None else out.when(c < bound, label)
    return F.when(c.isNotNull(), out.otherwise(bands[-1][1]))


def health_label(score: Column, scale: str = "documents") -> Column:
    return banded(score, HEALTH_SCALES[scale])


def health_score(readings: DataFrame) -> DataFrame:
    """(equipment_id, score): the whole part of the mean value, within 0 to 100.

    The mean is of decimals, so a whole one is whole in every order of the rows; values that
    a decimal does not hold leave it to doubles.
    """
    exact = F.col("value").try_cast("decimal(28,10)")
    mean = F.when(F.count(exact) == F.count("value"), F.floor(F.avg(exact)).cast("long")).otherwise(F.floor(F.avg("value")))
    return readings.groupBy("equipment_id").agg((mean % 101).alias("score"))


def week_end(ts: Column) -> Column:
    """The Sunday that ends the week."""
    return F.date_add(F.date_trunc("week", ts).cast("date"), 6)


def weekly(readings: DataFrame) -> DataFrame:
    """Statistics of (equipment_id, sensor, ts, value) per week; the trend is the slope of
    the value over seconds, taken from the week's own start to keep its digits."""
    w = readings.withColumn("week_end", week_end(F.col("ts")))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.date_sub("week_end", 6).cast("timestamp"))) / 1e6
    v = F.col("value")
    stats = [
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"),
        F.coalesce(F.regr_slope(v, F.col("s")), F.lit(0.0)).alias("trend"),
    ]
    return w.withColumn("s", seconds).groupBy("equipment_id", "week_end", "sensor").agg(*stats)


def pivoted(stats: DataFrame, sensors: list[str]) -> DataFrame:
    """A row per equipment and week, a column per sensor and statistic; 0 where missing."""
    cells = [F.coalesce(F.max(F.when(F.col("sensor") == s, F.col(x))), F.lit(0.0)).alias(f"{s}_{x}") for s in sensors for x in STATISTICS]
    return stats.groupBy("equipment_id", "week_end").agg(*cells)


def quality_features(readings: DataFrame) -> DataFrame:
    return readings.groupBy("equipment_id", week_end(F.col("ts")).alias("week_end")).agg(
        F.count("*").alias("readings"), F.count_if(F.col("quality") != "GOOD").alias("anomalies"), F.round(100.0 * F.count_if(F.col("quality") == "BAD") / F.count("*"), 4).alias("bad_pct")
    )


def labels(features: DataFrame, events: DataFrame, horizon_days: int = 30) -> DataFrame:
    """The worst event within the horizon after each week's end; 0 if there is none.

    Time is cut into bins of the horizon's width: a week's end is in one bin, an event's range in
    two at most.  They join on equipment and bin with an exact check of the days, so a long history
    never meets itself as a whole; the events of a day count once, with the worst.
    """
    severity = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("event_type")), F.lit(0))
    bin_of = lambda day: F.floor(day / (horizon_days + 1))
    bad = events.select(F.col("equipment_id").alias("e"), F.unix_date("event_date").alias("day"), severity.alias("severity")).where("severity > 0 and day is not null")
    worst = bad.groupBy("e", "day").agg(F.max("severity").alias("severity"))
    spans = worst.select("*", F.explode(F.sequence(bin_of(F.col("day") - horizon_days), bin_of(F.col("day")))).alias("event_bin"))
    weeks = features.select("equipment_id", "week_end").distinct().withColumn("end_day", F.unix_date("week_end")).withColumn("week_bin", bin_of(F.col("end_day")))
    near = (F.col("equipment_id") == F.col("e")) & (F.col("week_bin") == F.col("event_bin")) & (F.col("end_day") >= F.col("day") - horizon_days) & (F.col("end_day") <= F.col("day"))
    return weeks.join(spans, near, "left").groupBy("equipment_id", "week_end").agg(F.coalesce(F.max("severity"), F.lit(0)).cast("long").alias("severity"))


def state_as_of(readings: DataFrame, events: DataFrame, default: str = "HEALTHY", unit: str = "day") -> DataFrame:
    """Readings with the state that the last event at or before them led to; of several
    events at one time the greatest state counts.

    The history of an equipment is cut into days, each of which is put in order by itself.
    What a day starts with comes from one row per equipment and day, so no task needs to hold
    a whole history.
    """
    marks = events.select("equipment_id", F.col("event_ts").alias("ts"), F.col("state_to").alias("_state"), F.lit(0).alias("_side"))
    rows = readings.withColumns({"_state": F.lit(None).cast("string"), "_side": F.lit(1)})
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_block", F.date_trunc(unit, "ts"))
    block = ["equipment_id", "_block"]
    last = F.max_by("_state", F.when(F.col("_state").isNotNull(), F.struct("ts", "_state")))
    earlier = Window.partitionBy("equipment_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy(*block).agg(last.alias("_last")).select(*block, F.last("_last", ignorenulls=True).over(earlier).alias("_start"))
    within = Window.partitionBy(*block).orderBy("ts", "_side", "_state").rowsBetween(Window.unboundedPreceding, 0)
    ordered = both.withColumn("_now", F.last("_state", ignorenulls=True).over(within)).where("_side = 1")
    return ordered.join(starts, block).withColumn("state", F.coalesce("_now", "_start", F.lit(default))).drop("_state", "_side", "_block", "_now", "_start")


def transitions(events: DataFrame) -> DataFrame:
    """Each state with the state before, and the seconds until the next; open at the end."""
    w = Window.partitionBy("equipment_id").orderBy("event_ts", "state_to")
    span = F.unix_timestamp(F.lead("event_ts").over(w).cast("timestamp")) - F.unix_timestamp(F.col("event_ts").cast("timestamp"))
    return events.select("equipment_id", "event_ts", "state_to", F.lag("state_to").over(w).alias("state_from"), span.alias("seconds"))


def anomaly_count(readings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return readings.groupBy("equipment_id").agg(F.count_if((F.col("quality") != "GOOD") & (F.col("ts").cast("timestamp") >= since)).alias("anomalies"))


def latest_readings(readings: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("ts", "value", "quality"), F.struct("ts", "event_id"))
    return readings.groupBy("equipment_id", "sensor").agg(last.alias("x")).select("equipment_id", "sensor", "x.ts", "x.value", "x.quality")


def sensor_summary(readings: DataFrame) -> DataFrame:
    """The latest value of every sensor as one JSON object, in the order of the names."""
    cells = F.array_sort(F.collect_list(F.struct("sensor", F.round("value", 2).alias("value"))))
    return latest_readings(readings).groupBy("equipment_id").agg(F.to_json(F.map_from_entries(cells)).alias("summary"))


def split_half_trend(readings: DataFrame, band: float = 0.05) -> DataFrame:
    """Mean of the later against the earlier half of each sensor's rows."""
    keys = ["equipment_id", "sensor"]
    w = Window.partitionBy(*keys)
    ranked = readings.withColumns({"rn": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count("*").over(w)})
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    halves = ranked.groupBy(*keys).agg(F.avg(F.when(early, F.col("value"))).alias("first"), F.avg(F.when(~early, F.col("value"))).alias("second"))
    change = (F.col("second") - F.col("first")) / F.col("first")
    label = F.when(F.col("first").isNull() | (F.col("first") == 0), "stable").when(change > band, "increasing").when(change < -band, "decreasing").otherwise("stable")
    return halves.select(*keys, F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), label.alias("trend"))


def sensor_status(readings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Against a table of ranges (sensor, low, high), which has a row per sensor type."""
    v, lo, hi = F.col("value"), F.col("low"), F.col("high")
    status = F.when((v > hi * 1.2) | (v < lo * 0.8), "Critical").when((v > hi) | (v < lo), "Elevated").otherwise("Normal")
    return readings.join(ranges, "sensor").withColumn("status", status)


def excursions(readings: DataFrame, limit: float, minutes: int) -> DataFrame:
    """Islands of consecutive readings above a limit that last longer than ``minutes``."""
    keys = ["equipment_id", "sensor"]
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    high = readings.withColumn("above", F.col("value") > limit)
    starts = high.withColumn("start", (F.col("above") & ~F.coalesce(F.lag("above").over(w), F.lit(False))).cast("int"))
    runs = starts.withColumn("run", F.sum("start").over(w)).where("above")
    spans = runs.groupBy(*keys, "run").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("readings"))
    seconds = F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("began").cast("timestamp"))
    return spans.where(seconds > 60 * minutes).drop("run")


def bursts(readings: DataFrame, most: int = 3, days: int = 7) -> DataFrame:
    """Anomalies that are more than the ``most``-th within the days up to them."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("equipment_id", "sensor").orderBy(seconds).rangeBetween(-days * 86400, 0)
    odd = readings.where("quality <> 'GOOD'").withColumn("in_window", F.count("*").over(w))
    return odd.where(F.col("in_window") > most).select("equipment_id", "sensor", "event_id", "in_window")


def scored(probabilities: DataFrame) -> DataFrame:
    """Risk, failure probability, health score, remaining days and action from p_low to
    p_critical; scores round half to even, remaining days are the bucket's middle."""
    ps = [F.col(f"p_{r.lower()}") for r in RISKS]
    top = F.greatest(*ps)
    risk = F.coalesce(*(F.when(p == top, r) for p, r in zip(ps, RISKS)))
    failure = 1 - ps[0]
    days = banded(failure, [(b, (lo + hi) // 2) for b, lo, hi in REMAINING])
    score = F.bround(sum((p * WEIGHTS[r] for p, r in zip(ps, RISKS)), F.lit(0.0)), 0).cast("long")
    action = F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("risk"))
    return probabilities.withColumns({"risk": risk, "failure_probability": F.round(failure, 4), "health_score": score, "remaining_days": days.cast("long")}).withColumn("action", action)


def next_maintenance(as_of: Column, days: Column, cap: str) -> Column:
    return F.least(F.date_add(as_of, days.cast("int")), F.lit(cap).cast("date"))


def top_factors(rows: DataFrame, features: list[str], importance: list[float], n: int = 3) -> DataFrame:
    """Names of the n features with the largest absolute value times importance."""
    parts = F.array(*(F.struct((-F.abs(F.col(f)) * w).alias("x"), F.lit(f).alias("name")) for f, w in zip(features, importance)))
    return rows.withColumn("top_factors", F.transform(F.slice(F.array_sort(parts), 1, n), lambda s: s["name"]))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column; the shares need one row per value in one place."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def status(health: DataFrame, equipment_id, anomalies: DataFrame, maintenance: DataFrame) -> DataFrame:
    """The health row of one equipment with its anomalies and last maintenance; no row if it is
    unknown.  The equality reaches all three scans through the join key."""
    one = health.where(F.col("equipment_id") == F.lit(equipment_id))
    joined = one.join(anomalies, "equipment_id", "left").join(maintenance, "equipment_id", "left")
    return joined.withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))


def by_risk(health: DataFrame, n: int = 20) -> DataFrame:
    return health.orderBy(F.desc("failure_probability"), "equipment_id").limit(n)


def in_lookback(readings: DataFrame, as_of: str, hours: int, limit: int, **equals) -> DataFrame:
    """The latest readings before ``as_of``, with optional equality filters."""
    at = F.lit(as_of).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    rows = readings.where((ts >= at - F.make_dt_interval(hours=F.lit(hours))) & (ts <= at))
    for column, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def monthly(readings: DataFrame, sensors: list[str]) -> DataFrame:
    """Mean and maximum per sensor, readings, anomalies and share of bad ones, in one pass."""
    cells = [f(F.when(F.col("sensor") == s, F.col("value"))).alias(f"{n}_{s}") for s in sensors for n, f in (("avg", lambda c: F.round(F.avg(c), 6)), ("max", F.max))]
    return readings.groupBy("equipment_id", F.trunc(F.col("ts").cast("date"), "month").alias("month_start")).agg(
        *cells, F.count("*").alias("readings"), F.count_if(F.col("quality") != "GOOD").alias("anomalies"), F.round(100.0 * F.count_if(F.col("quality") == "BAD") / F.count("*"), 4).alias("bad_pct")
    )


def monthly_full(metrics: DataFrame, health: DataFrame, maintenance: DataFrame) -> DataFrame:
    """``metrics`` with the mean and least health of each month, and how often it was maintained."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month").alias("month_start")
    keys = ["equipment_id", "month_start"]
    scores = health.groupBy("equipment_id", month("day")).agg(F.round(F.avg("health"), 6).alias("health_avg"), F.min("health").alias("health_min"))
    jobs = maintenance.groupBy("equipment_id", month("event_ts")).agg(F.count("*").alias("maintenances"))
    return metrics.join(scores, keys, "left").join(jobs, keys, "left").withColumn("maintenances", F.coalesce("maintenances", F.lit(0)))


def most_at_risk(health: DataFrame, site: str, order: list, n: int = 5) -> DataFrame:
    """The n riskiest of every site, with their rank."""
    return top_n(health, [site], order, n)
