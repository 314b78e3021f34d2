import datetime
import random

import pytest

from lodestrata.streaming import lifecycle, micro

DAY = lifecycle.DAY
LASTS = {1: (90, 2), 2: (21, 3), 3: (7, 4), 4: (3, 5), 5: (3, 0)}


def batch(events, until):
    """The whole history of each equipment at once, up to and including ``until``."""
    out = []
    for key in sorted({e[0] for e in events}):
        own = sorted({(t, s) for k, t, s in events if k == key and t <= until})
        if not own:
            continue
        state, since = 0, own[0][0]
        for t, s in [*own, (until, None)]:
            while state in LASTS and since + LASTS[state][0] * DAY <= t:
                state, since, was = LASTS[state][1], since + LASTS[state][0] * DAY, state
                out.append((key, since, micro.STATES[was], micro.STATES[state], "time"))
            to = state if s is None else 5 if s < 0 else s if state in (0, 5) else max(state, s)
            if to != state:
                out.append((key, t, micro.STATES[state], micro.STATES[to], "reading"))
                state, since = to, t
    return sorted(out)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, lifecycle.STATE_STORE)
    yield
    spark.conf.set(name, before)


def test_stream_equals_batch(spark, store, tmp_path):
    rng = random.Random(3)
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    events = [(k, start + rng.randrange(200) * DAY + rng.choice([0, 3_600_000]), rng.choice([-1, 0, 0, 1, 1, 2, 3, 4])) for k in range(5) for _ in range(8)]
    events += [(9, start, 1), (8, start, 4), (7, start + 5 * DAY, 0)]  # whose states end without another reading
    last = max(t for _, t, _ in events) + 120 * DAY
    events.append((100, last, 0))  # moves the watermark past all ends
    events.sort(key=lambda e: (e[1] // (20 * DAY), rng.random()))  # out of order within 20 days
    schema = "equipment_id long, ts timestamp, severity int"
    for n, at in enumerate(range(0, len(events), 11)):
        rows = [(k, datetime.datetime.fromtimestamp(t / 1000, datetime.timezone.utc), s) for k, t, s in events[at : at + 11]]
        spark.createDataFrame(rows + [(None, None, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n:02d}")
    stream = micro.file_source(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, per_batch=1)
    out = lifecycle.transitions(stream, late="21 days")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == batch(events, last - 21 * DAY)
    assert sum(r[4] == "time" for r in got) > 10 and {r[0] for r in got} >= {8, 9}
