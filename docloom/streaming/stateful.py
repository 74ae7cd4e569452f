"""Streams with state by key: the best value so far, early stop after steps without a better one, and the end of a key.

State lives in the checkpoint's store, not in a task, so a run that dies goes on with every key where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several states and timers for a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Best(StatefulProcessor):
    """Steps of a key in their order: best before, improved, streak, stopped; and a last row when the key has been idle."""

    def __init__(self, by: str, value: str, order: list[str], ts: str, patience: int, idle_ms: int):
        self.by, self.value, self.order, self.ts, self.patience, self.idle_ms = by, value, order, ts, patience, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("steps", "best double, streak int, stopped boolean, steps bigint, last bigint")

    def _row(self, key: tuple, place: list, *told) -> Row:
        return Row(**dict(zip((self.by, *self.order, "best_before", "improved", "streak", "stopped", "ended"), (*key, *place, *told))))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, streak, stopped, steps, last = self.state.get() if self.state.exists() else (None, 0, False, 0, None)
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            value = r[self.value]
            better = best is None or (value is not None and value > best)
            streak = 0 if better else streak + 1
            stopped = stopped or streak >= self.patience
            steps += 1
            yield self._row(key, [r[c] for c in self.order], best, better, streak, stopped, False)
            best = value if best is None else best if value is None else max(best, value)
            now = int(r[self.ts].timestamp() * 1000) if r[self.ts] is not None else None
            last = now if last is None else last if now is None else max(last, now)
        self.state.update((best, streak, stopped, steps, last))
        if self.idle_ms and last is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        best, streak, stopped, _, _ = self.state.get()
        self.state.clear()
        yield self._row(key, [None] * len(self.order), best, False, streak, stopped, True)

    def close(self) -> None:
        return


def best_so_far(events: DataFrame, value: str, by: str, order: list[str], ts: str, patience: int = 3, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """(by, order, best_before, improved, streak, stopped, ended) for each event of a stream: aggregates.best_so_far, by batch.

    Events of a key count in their order inside a batch, and after those of batches before. idle: once the watermark is
    that far past a key's last event, a row with ended gives its best, and its state goes; null keeps keys for ever.
    """
    prepared(events.sparkSession)
    idle_ms = _milliseconds(idle) if idle else 0
    timed = events.withWatermark(ts, late) if idle else events
    kinds = {f.name: f.dataType for f in events.schema}
    fields = [(by, kinds[by]), *[(c, kinds[c]) for c in order], ("best_before", T.DoubleType()), ("improved", T.BooleanType()), ("streak", T.IntegerType()), ("stopped", T.BooleanType()), ("ended", T.BooleanType())]
    out = T.StructType([T.StructField(n, k) for n, k in fields])
    return timed.groupBy(by).transformWithState(statefulProcessor=_Best(by, value, order, ts, patience, idle_ms), outputStructType=out, outputMode="Append", timeMode="EventTime" if idle else "None")


_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(text: str) -> int:
    """The length of an interval such as '30 minutes'."""
    number, unit = text.split()
    return int(number) * _UNITS[unit.rstrip("s")]
