"""The life cycle of equipment as a state machine with event-time timers.

Readings raise the state of an equipment to their severity, maintenance (severity -1) and the
first healthy reading after it bring it back; and a state that lasts its full time ends by itself,
whether or not another reading comes.  Readings wait, by their time, until the watermark has passed
them, so that the order of files does not matter; a timer stands at each of these times and at the
end of the present state.

Edge cases: readings of one equipment and time count as one set, maintenance first, then from
the least severity up; a state ends before the readings of that moment count; readings
without a time, an equipment or a severity are left out; a severity above the worst counts as the
worst; readings later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.streaming.micro import LATE, STATES

DAY = 86_400_000
#: The most days each state lasts, and what follows.
LASTS = {"DEGRADING": (90, "WARNING"), "WARNING": (21, "CRITICAL"), "CRITICAL": (7, "FAILED"), "FAILED": (3, "MAINTAINED"), "MAINTAINED": (3, "HEALTHY")}
WORST = 4
TRANSITIONS = "equipment_id long, at_ms long, state_from string, state_to string, cause string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ends(state: int, since: int) -> int | None:
    """When a state that began at ``since`` is over."""
    days = LASTS.get(STATES[state], (None, ""))[0]
    return None if days is None else since + days * DAY


def after(state: int, severity: int) -> int:
    """The state after a reading."""
    if severity < 0:
        return STATES.index("MAINTAINED")
    healthy = STATES[state] in ("HEALTHY", "MAINTAINED")
    return severity if healthy else max(state, severity)


class Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state int, since long")
        self.waiting = handle.getMapState("waiting", "ts long", "severities int")  # bit s + 1 for severity s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            known = self.waiting.getValue((r.at_ms,)) if self.waiting.containsKey((r.at_ms,)) else (0,)
            self.waiting.updateValue((r.at_ms,), (known[0] | 1 << (min(max(r.severity, -1), WORST) + 1),))
            self.handle.registerTimer(r.at_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        state, since = self.now.get() if self.now.exists() else (0, at)
        out = []

        def move(to: int, when: int, cause: str) -> None:
            nonlocal state, since
            out.append(Row(equipment_id=key[0], at_ms=when, state_from=STATES[state], state_to=STATES[to], cause=cause))
            state, since = to, when

        def run_out(until: int) -> None:
            while (end := ends(state, since)) is not None and end <= until:
                move(STATES.index(LASTS[STATES[state]][1]), end, "time")

        run_out(at)
        if self.waiting.containsKey((at,)):
            bits = self.waiting.getValue((at,))[0]
            self.waiting.removeKey((at,))
            for severity in range(-1, WORST + 1):
                if bits >> (severity + 1) & 1 and (to := after(state, severity)) != state:
                    move(to, at, "reading")
        end = ends(state, since)
        if end is not None and end <= mark:  # already past: what waits decides how far time may run
            left = [k[0] for k in self.waiting.keys()]
            run_out(min([mark, *left]))
            end = ends(state, since)
        if end is not None:
            self.handle.registerTimer(end)
        self.now.update((state, since))
        return iter(out)

    def close(self) -> None:
        pass


def transitions(readings: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """(equipment_id, at_ms, state_from, state_to, cause) of a stream of (equipment_id, ts, severity).

    Needs the RocksDB state store (``STATE_STORE`` as ``spark.sql.streaming.stateStore.providerClass``).
    """
    own = readings.select(F.col("equipment_id").cast("long").alias("equipment_id"), F.col(ts).cast("timestamp").alias("at"), F.col("severity").cast("int").alias("severity"))
    own = own.where("equipment_id is not null and at is not null and severity is not null").withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return own.groupBy("equipment_id").transformWithState(Lifecycle(), TRANSITIONS, "append", "eventtime")
