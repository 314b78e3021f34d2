"""Made-up numbers that are the same in every run: draws by hash, seasons, sensor values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least and greatest reading, decimal places and unit of each kind of sensor.
SENSORS = {
    "temperature": (35, 55, 2, "°C"), "vibration": (1, 4, 3, "mm/s"), "pressure": (2, 6, 2, "bar"), "humidity": (30, 60, 1, "%RH"), "flow_rate": (50, 200, 1, "L/min"), "power": (1, 10, 2, "kW"),
}
# Shares of readings that are bad, and that are bad or uncertain.
BAD, DOUBTFUL = 0.02, 0.05


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A number from 0 up to 1 for each combination of ``keys``; null keys count as absent."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def normal(seed: int | str, *keys: str | Column) -> Column:
    """A draw of the standard normal distribution, from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(f"{seed}a", *keys))) * F.cos(2 * math.pi * uniform(f"{seed}b", *keys))


def gamma(shape: int, seed: int | str, *keys: str | Column) -> Column:
    """A draw of a gamma distribution of scale 1 with a whole shape: a sum of exponential ones."""
    out = F.lit(0.0)
    for i in range(shape):
        out = out - F.log(1 - uniform(f"{seed}.{i}", *keys))
    return out


def seasonal(place: Column, period: float, amplitude: float = 1.0) -> Column:
    """A sine over ``place`` that repeats after ``period``."""
    return amplitude * F.sin(2 * math.pi * place / period)


def sensor_readings(rows: DataFrame, key: str, seed: int, sensors: dict = SENSORS) -> DataFrame:
    """For each row of ``rows`` and each kind of sensor: value within its range, unit and flag."""
    kinds = F.array(*(F.struct(F.lit(s).alias("sensor"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit(unit).alias("unit")) for s, (lo, hi, _, unit) in sensors.items()))
    made = rows.select(key, F.inline(kinds))
    raw = F.col("lo") + uniform(seed, key, "sensor") * (F.col("hi") - F.col("lo"))
    value = F.coalesce(*(F.when(F.col("sensor") == s, F.round(raw, places)) for s, (_, _, places, _) in sensors.items()))
    luck = uniform(f"{seed}q", key, "sensor")
    flag = F.when(luck < BAD, "BAD").when(luck < DOUBTFUL, "UNCERTAIN").otherwise("GOOD")
    return made.select(key, "sensor", value.alias("value"), "unit", flag.alias("quality"))
