"""Queries over sensor readings; ``events`` stands in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import equipment
from lodestrata.plans.registry import query
from lodestrata.sources.readers import table

AS_OF = "2024-01-28 00:00:00"
READ_SQL = """
with r as (
  select event_id, user_id as equipment_id, event_type as sensor, ts, value, case when k < 2 then 'BAD' when k < 5 then 'UNCERTAIN' else 'GOOD' end as quality,
    cast(ts as date) + cast(7 - isodow(ts) as int) as week_end
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)
)
"""
STATES_SQL = """, e as (
  select user_id as equipment_id, ts as event_ts, event_type, case event_type when 'purchase' then 'failure' when 'signup' then 'critical' when 'click' then 'degradation_start' else 'none' end as kind, event_type as state_to
  from events
)
"""


def readings(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    quality = F.when(k < 2, "BAD").when(k < 5, "UNCERTAIN").otherwise("GOOD")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("equipment_id"), F.col("event_type").alias("sensor"), "ts", "value", quality.alias("quality"))


def _sensors():
    return ["click", "purchase", "signup", "view", "error"]


def equipment_events(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "failure").when(F.col("event_type") == "signup", "critical").when(F.col("event_type") == "click", "degradation_start").otherwise("none")
    return table(spark, sf, "events").select(F.col("user_id").alias("equipment_id"), F.col("ts").alias("event_ts"), F.col("event_type").alias("state_to"), kind.alias("kind"))


_WEEK = ", w as (select equipment_id, week_end, sensor, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, min(value) as min, max(value) as max, max(value) - min(value) as range, case when count(distinct ts) < 2 then 0 else regr_slope(value, epoch_us(ts) / 1e6 - epoch(week_end - 6)) end as trend from r group by 1, 2, 3)"
_ROUND = "round(mean, 6) as mean, round(std, 6) as std, min, max, round(range, 6) as range"


@query(READ_SQL + _WEEK + f"select equipment_id, week_end, sensor, {_ROUND} from w")
def sensor_week_stats(spark, sf):
    w = equipment.weekly(readings(spark, sf)).drop("trend")
    return w.withColumns({c: F.round(c, 6) for c in ("mean", "std", "range")})


@query(READ_SQL + _WEEK + "select equipment_id, week_end, sensor, round(trend * 86400, 2) + 0.0 as trend_per_day from w")
def sensor_trend(spark, sf):
    return equipment.weekly(readings(spark, sf)).select("equipment_id", "week_end", "sensor", (F.round(F.col("trend") * 86400, 2) + 0.0).alias("trend_per_day"))


@query(READ_SQL + _WEEK + "select equipment_id, week_end, " + ", ".join(f"round(coalesce(max({x}) filter (where sensor = '{s}'), 0), 6) as {s}_{x}" for s in _sensors() for x in ("mean", "std", "min", "max", "range")) + " from w group by 1, 2")
def sensor_pivot(spark, sf):
    out = equipment.pivoted(equipment.weekly(readings(spark, sf)), _sensors())
    return out.select("equipment_id", "week_end", *(F.round(c, 6).alias(c) for c in out.columns[2:] if not c.endswith("_trend")))


@query(READ_SQL + "select equipment_id, week_end, count(*) as readings, count(*) filter (where quality <> 'GOOD') as anomalies, round(100.0 * count(*) filter (where quality = 'BAD') / count(*), 4) as bad_pct from r group by 1, 2")
def quality_features(spark, sf):
    return equipment.quality_features(readings(spark, sf))


@query(READ_SQL + STATES_SQL + """, f as (select distinct equipment_id, week_end from r), s as (select equipment_id, cast(event_ts as date) as d, case kind when 'failure' then 3 when 'critical' then 3 when 'degradation_start' then 1 else 0 end as severity from e)
select f.equipment_id, f.week_end, cast(coalesce(max(severity), 0) as bigint) as severity from f left join s on s.equipment_id = f.equipment_id and severity > 0 and f.week_end between d - 30 and d group by 1, 2""")
def failure_labels_range_join(spark, sf):
    events = equipment_events(spark, sf).select("equipment_id", F.col("event_ts").cast("date").alias("event_date"), F.col("kind").alias("event_type"))
    features = readings(spark, sf).select("equipment_id", equipment.week_end(F.col("ts")).alias("week_end"))
    return equipment.labels(features, events)


@query(READ_SQL + STATES_SQL + """, o as (select equipment_id, event_ts, max(state_to) as state_to from e group by 1, 2)
select r.event_id, r.equipment_id, coalesce(o.state_to, 'HEALTHY') as state from r asof left join o on r.equipment_id = o.equipment_id and r.ts >= o.event_ts""")
def asof_state(spark, sf):
    states = equipment_events(spark, sf).groupBy("equipment_id", "event_ts").agg(F.max("state_to").alias("state_to"))
    return equipment.state_as_of(readings(spark, sf), states).select("event_id", "equipment_id", "state")


@query(READ_SQL + STATES_SQL + "select equipment_id, event_ts, state_to, lag(state_to) over w as state_from, cast(floor(epoch(lead(event_ts) over w)) - floor(epoch(event_ts)) as bigint) as seconds from e window w as (partition by equipment_id order by event_ts, state_to)")
def state_transitions(spark, sf):
    return equipment.transitions(equipment_events(spark, sf))


@query(READ_SQL + f"select equipment_id, count(*) filter (where quality <> 'GOOD' and ts >= timestamp '{AS_OF}' - interval 14 days) as anomalies from r group by 1")
def anomaly_count_30d(spark, sf):
    return equipment.anomaly_count(readings(spark, sf), AS_OF, 14)


@query(READ_SQL + "select equipment_id, sensor, ts, value, quality from r qualify row_number() over (partition by equipment_id, sensor order by ts desc, event_id desc) = 1")
def latest_reading_per_sensor(spark, sf):
    return equipment.latest_readings(readings(spark, sf))


@query(READ_SQL + """, l as (select equipment_id, sensor, round(value, 2) as value from r qualify row_number() over (partition by equipment_id, sensor order by ts desc, event_id desc) = 1)
select equipment_id, count(*) as sensors, round(sum(value), 2) as total from l group by 1""")
def sensor_summary_json(spark, sf):
    """Reads its own JSON back, so that the text of numbers does not matter."""
    back = equipment.sensor_summary(readings(spark, sf)).select("equipment_id", F.map_values(F.from_json("summary", "map<string,double>")).alias("v"))
    return back.select("equipment_id", F.size("v").cast("long").alias("sensors"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(READ_SQL + """, n as (select *, row_number() over (partition by equipment_id, sensor order by ts, event_id) as rn, count(*) over (partition by equipment_id, sensor) as n from r),
h as (select equipment_id, sensor, avg(value) filter (where rn <= floor(n / 2)) as a, avg(value) filter (where rn > floor(n / 2)) as b from n group by 1, 2)
select equipment_id, sensor, round(a, 6) as first, round(b, 6) as second, case when a is null or a = 0 then 'stable' when (b - a) / a > 0.05 then 'increasing' when (b - a) / a < -0.05 then 'decreasing' else 'stable' end as trend from h""")
def split_half_trend(spark, sf):
    return equipment.split_half_trend(readings(spark, sf))


_SCORE = "score as (select equipment_id, cast(floor(avg(value)) as bigint) % 101 as score from r group by 1)"


@query(READ_SQL + f", {_SCORE} select *, case when score < 25 then 'Critical' when score < 50 then 'Warning' when score < 75 then 'Good' else 'Excellent' end as label, case when score < 20 then 'Critical' when score < 40 then 'Poor' when score < 60 then 'Fair' when score < 80 then 'Good' else 'Excellent' end as agent_label from score")
def health_label(spark, sf):
    score = equipment.health_score(readings(spark, sf))
    return score.select("*", equipment.health_label(F.col("score")).alias("label"), equipment.health_label(F.col("score"), "agent").alias("agent_label"))


@query(READ_SQL + "select event_id, sensor, case when value > 60 * 1.2 or value < 20 * 0.8 then 'Critical' when value > 60 or value < 20 then 'Elevated' else 'Normal' end as status from r where sensor in ('click', 'view')")
def sensor_status(spark, sf):
    ranges = spark.createDataFrame([("click", 20.0, 60.0), ("view", 20.0, 60.0)], "sensor string, low double, high double")
    return equipment.sensor_status(readings(spark, sf), ranges).select("event_id", "sensor", "status")


@query(READ_SQL + "select quality, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from r group by 1")
def risk_distribution(spark, sf):
    return equipment.distribution(readings(spark, sf), "quality")


def _probabilities(spark, sf):
    """Class probabilities by a rule on the key: sixteenths that add up to one."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("equipment_id"), (k % 7).alias("a"), (k % 4).alias("b"), (k % 3).alias("c"))
    return rows.select("equipment_id", ((16 - F.col("a") - F.col("b") - F.col("c")) / 16).alias("p_low"), (F.col("a") / 16).alias("p_medium"), (F.col("b") / 16).alias("p_high"), (F.col("c") / 16).alias("p_critical"))


_SCORED = """
with p as (select c_custkey as equipment_id, (16 - c_custkey % 7 - c_custkey % 4 - c_custkey % 3) / 16.0 as p_low, (c_custkey % 7) / 16.0 as p_medium, (c_custkey % 4) / 16.0 as p_high, (c_custkey % 3) / 16.0 as p_critical from customer),
q as (select *, greatest(p_low, p_medium, p_high, p_critical) as top, 100 * p_low + 70 * p_medium + 30 * p_high as raw, 1 - p_low as f from p),
s as (
  select equipment_id, case when p_low = top then 'Low' when p_medium = top then 'Medium' when p_high = top then 'High' else 'Critical' end as risk, cast(round(f, 4) as double) as failure_probability,
    cast(case when raw - floor(raw) = 0.5 then 2 * round(raw / 2) else round(raw) end as bigint) as health_score,
    cast(case when f < 0.2 then 272 when f < 0.4 then 135 when f < 0.6 then 60 when f < 0.8 then 18 else 4 end as bigint) as remaining_days from q
)
"""


@query(_SCORED + "select *, case risk when 'Low' then 'Continue routine monitoring' when 'Medium' then 'Schedule inspection within 60 days' when 'High' then 'Plan maintenance within 2 weeks' else 'Immediate maintenance required' end as action, least(date '2025-10-01' + cast(remaining_days as int), date '2025-12-31') as next_maintenance from s")
def health_scoring(spark, sf):
    out = equipment.scored(_probabilities(spark, sf)).withColumn("next_maintenance", equipment.next_maintenance(F.lit("2025-10-01").cast("date"), F.col("remaining_days"), "2025-12-31"))
    return out.drop("p_low", "p_medium", "p_high", "p_critical")


@query(_SCORED + "select * from s order by failure_probability desc, equipment_id limit 20")
def equipment_by_risk_topk(spark, sf):
    out = equipment.scored(_probabilities(spark, sf)).drop("action", "p_low", "p_medium", "p_high", "p_critical")
    return equipment.by_risk(out, 20)


@query(_SCORED + """, t as (select equipment_id, unnest([{'x': p_medium * 0.5, 'n': 'p_medium'}, {'x': p_high * 0.3, 'n': 'p_high'}, {'x': p_critical * 0.2, 'n': 'p_critical'}, {'x': p_low * 0.1, 'n': 'p_low'}]) as s from p),
r as (select equipment_id, s.n as n, row_number() over (partition by equipment_id order by cast(s.x as double) desc, s.n) as k from t) select equipment_id, string_agg(n, ',' order by k) as factors from r where k <= 3 group by 1""")
def top_risk_factors(spark, sf):
    out = equipment.top_factors(_probabilities(spark, sf), ["p_medium", "p_high", "p_critical", "p_low"], [0.5, 0.3, 0.2, 0.1])
    return out.select("equipment_id", F.array_join("top_factors", ",").alias("factors"))


@query(READ_SQL + f"select event_id, equipment_id, sensor, ts, value, quality from r where ts between timestamp '{AS_OF}' - interval 48 hours and timestamp '{AS_OF}' and sensor = 'click' order by ts desc, event_id desc limit 200")
def sensor_readings_lookback(spark, sf):
    return equipment.in_lookback(readings(spark, sf), AS_OF, 48, 200, sensor="click", quality=None)


@query(READ_SQL + f"select event_id, equipment_id, sensor, ts, value, quality from r where quality <> 'GOOD' and ts between timestamp '{AS_OF}' - interval 240 hours and timestamp '{AS_OF}' order by ts desc, event_id desc limit 100")
def equipment_anomalies(spark, sf):
    return equipment.in_lookback(readings(spark, sf).where("quality <> 'GOOD'"), AS_OF, 240, 100)


@query(READ_SQL + "select sensor, quality, count(*) as n, min(ts) as first_seen, max(ts) as last_seen from r where quality <> 'GOOD' group by 1, 2")
def anomalies_by_sensor(spark, sf):
    return readings(spark, sf).where("quality <> 'GOOD'").groupBy("sensor", "quality").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query(READ_SQL + """, s as (select *, value > 30 and not coalesce(lag(value) over w > 30, false) as start from r window w as (partition by equipment_id, sensor order by ts, event_id)),
u as (select *, sum(cast(start as int)) over (partition by equipment_id, sensor order by ts, event_id rows unbounded preceding) as run from s)
select equipment_id, sensor, min(ts) as began, max(ts) as ended, count(*) as readings from u where value > 30 group by equipment_id, sensor, run having floor(epoch(max(ts))) - floor(epoch(min(ts))) > 1800""")
def sustained_excursion(spark, sf):
    return equipment.excursions(readings(spark, sf), 30.0, 30)


@query(READ_SQL + """, b as (select equipment_id, sensor, event_id, count(*) over (partition by equipment_id, sensor order by cast(floor(epoch(ts)) as bigint) range between 604800 preceding and current row) as in_window from r where quality <> 'GOOD')
select * from b where in_window > 1""")
def anomaly_burst_7d(spark, sf):
    return equipment.bursts(readings(spark, sf), 1)


@query(READ_SQL + "select equipment_id, cast(date_trunc('month', ts) as date) as month_start, " + ", ".join(f"round(avg(value) filter (where sensor = '{s}'), 6) as avg_{s}, max(value) filter (where sensor = '{s}') as max_{s}" for s in ("click", "view")) + ", count(*) as readings, count(*) filter (where quality <> 'GOOD') as anomalies, round(100.0 * count(*) filter (where quality = 'BAD') / count(*), 4) as bad_pct from r group by 1, 2")
def monthly_equipment_metrics(spark, sf):
    return equipment.monthly(readings(spark, sf), ["click", "view"])


@query("select c_custkey % 50 as plant, string_agg(distinct cast(c_nationkey as varchar), ',' order by cast(c_nationkey as varchar)) as devices, min(c_mktsegment) as line from customer group by 1")
def device_list(spark, sf):
    devices = F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",")
    return table(spark, sf, "customer").groupBy((F.col("c_custkey") % 50).alias("plant")).agg(devices.alias("devices"), F.min("c_mktsegment").alias("line"))


@query("select c_nationkey as plant, count(*) as n, round(avg(c_acctbal), 4) as avg_score, count(*) filter (where c_acctbal < 0) as at_risk, cast(max(c_acctbal) as double) as top from customer group by 1")
def fleet_overview(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("plant")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_score"), F.count_if(F.col("c_acctbal") < 0).alias("at_risk"), F.max("c_acctbal").alias("top"))


@query("select user_id as equipment_id, cast(max(ts) as date) as last_maintenance from events where event_type = 'purchase' group by 1")
def latest_maintenance(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("equipment_id")).agg(F.max("ts").cast("date").alias("last_maintenance"))


_STATUS_SQL = _SCORED + f""", a as (select user_id as equipment_id, count(*) filter (where cast(json_extract_string(props, '$.k') as int) < 5 and ts >= timestamp '{AS_OF}' - interval 30 days) as anomalies from events group by 1),
m as (select user_id as equipment_id, cast(max(ts) as date) as last_maintenance from events where event_type = 'purchase' group by 1)
select s.*, coalesce(anomalies, 0) as anomalies, last_maintenance from s left join a using (equipment_id) left join m using (equipment_id) where equipment_id = 7"""


@query(_STATUS_SQL)
def get_equipment_status(spark, sf):
    """A lookup of one equipment; a score of zero stays zero."""
    health = equipment.scored(_probabilities(spark, sf)).drop("action", "p_low", "p_medium", "p_high", "p_critical")
    return equipment.status(health, 7, equipment.anomaly_count(readings(spark, sf), AS_OF, 30), latest_maintenance(spark, sf))


@query(READ_SQL + """, d as (select equipment_id, cast(ts as date) as day, round(100.0 * count(*) filter (where quality = 'GOOD') / count(*), 4) as health from r group by 1, 2),
m as (select equipment_id, cast(date_trunc('month', ts) as date) as month_start, round(avg(value) filter (where sensor = 'click'), 6) as avg_click, max(value) filter (where sensor = 'click') as max_click, count(*) as readings, count(*) filter (where quality <> 'GOOD') as anomalies, round(100.0 * count(*) filter (where quality = 'BAD') / count(*), 4) as bad_pct from r group by 1, 2),
h as (select equipment_id, cast(date_trunc('month', day) as date) as month_start, round(avg(health), 6) as health_avg, min(health) as health_min from d group by 1, 2),
j as (select equipment_id, cast(date_trunc('month', ts) as date) as month_start, count(*) as maintenances from r where sensor = 'purchase' group by 1, 2)
select m.*, health_avg, health_min, coalesce(maintenances, 0) as maintenances from m left join h using (equipment_id, month_start) left join j using (equipment_id, month_start)""")
def monthly_equipment_full(spark, sf):
    """Health of a day: the share of its readings that are good."""
    r = readings(spark, sf)
    good = F.round(100.0 * F.count_if(F.col("quality") == "GOOD") / F.count("*"), 4)
    health = r.groupBy("equipment_id", F.col("ts").cast("date").alias("day")).agg(good.alias("health"))
    return equipment.monthly_full(equipment.monthly(r, ["click"]), health, equipment_events(spark, sf).where("kind = 'failure'"))


@query("select plant, c_custkey, c_acctbal, rank from (select c_nationkey as plant, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as rank from customer) where rank <= 5")
def fleet_top_risk(spark, sf):
    scores = table(spark, sf, "customer").select(F.col("c_nationkey").alias("plant"), "c_custkey", "c_acctbal")
    return equipment.most_at_risk(scores, "plant", ["c_acctbal", "c_custkey"])
