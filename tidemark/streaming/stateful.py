"""Streams with state of their own: changes debounced by timers, and rolling latencies.

State lives in the RocksDB store, by key and spread over the shuffle partitions, and goes through
checkpoints like any other, so a query that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FLUSHED = "scope string, path string, kind string, n bigint, first bigint, due bigint"
ROLLING = "backend string, n int, p50 double, p95 double"


def with_state_store(spark: SparkSession) -> None:
    """State of arbitrary form needs the RocksDB store; set for queries that start from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Debounce(StatefulProcessor):
    """Pending changes of one scope. The first starts a timer that later ones don't put off; when it
    is due all go out, the last kind of each path. Times are those of events: rows are
    taken in the order of (ts, event_id), one at or after the due time flushes what is pending before it, and the watermark does so
    where no row follows."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "kind string, n bigint, first bigint")
        self.due = handle.getValueState("due", "due bigint")

    def _flush(self, scope: str, due: int, own: dict, held: bool) -> Iterator[Row]:
        # one row for each path of the scope; ``own`` goes before what the state holds
        rows = {path: value for (path,), value in self.pending.iterator()} | own if held else own
        for path, (kind, n, first) in sorted(rows.items(), key=lambda x: x[0]):
            yield Row(scope=scope, path=path, kind=kind, n=n, first=first, due=due)
        if held:
            self.pending.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # each call to the state is a way to the JVM and back: a path is read once at most, and what is left is written at the end
        before = self.due.get()
        before = before[0] if before else None
        due, own, held = before, {}, before is not None
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if due is not None and row.at >= due:
                yield from self._flush(key[0], due, own, held)
                due, own, held = None, {}, False
            if due is None:
                due = row.at + self.delay_ms * 1000
            old = own.get(row.path)
            if old is None and held and self.pending.containsKey((row.path,)):
                old = self.pending.getValue((row.path,))
            own[row.path] = (row.kind, old[1] + 1 if old else 1, old[2] if old else row.at)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(_timer(before))
            self.due.update((due,))
            self.handle.registerTimer(_timer(due))
        for path, value in own.items():
            self.pending.updateValue((path,), value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.due.get()
        if due and _timer(due[0]) == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._flush(key[0], due[0], {}, True)
            self.due.clear()

    def close(self) -> None:
        pass


def _timer(due: int) -> int:
    """Timers are of milliseconds; one is due when all of its last millisecond has passed."""
    return -(-due // 1000)


def debounced(events: DataFrame, delay: float = 2.0, scope: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of (ts, event_id, kind, path) as flushes (scope, path, kind, n, first, due).

    Each path is its own scope unless ``scope`` names a column, such as the watched folder: then the first
    pending event of the scope starts the timer for all of its paths. Events may come ``late``; later ones are dropped. Equal
    (ts, event_id) count in any order. Null paths are dropped; a null kind goes out as it is."""
    with_state_store(events.sparkSession)
    own = events.where("path is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"), "kind", "path", F.col(scope or "path").cast("string").alias("scope"))
    own = own.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    found = own.groupBy("scope").transformWithState(Debounce(round(delay * 1000)), FLUSHED, "Append", "EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first", "due")})


class Rolling(StatefulProcessor):
    """The last samples of one backend; those before are evicted."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "at bigint, event_id bigint, ms double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = list(self.samples.get()) if self.samples.exists() else []
        new = [(r.at, r.event_id, r.ms) for r in rows]
        held = sorted([tuple(x) for x in held] + new)[-self.last :]
        self.samples.put(held)
        values = sorted(x[2] for x in held)
        yield Row(backend=key[0], n=len(values), p50=_exclusive(values, 10), p95=_exclusive(values, 19))

    def close(self) -> None:
        pass


def _exclusive(values: list[float], i: int) -> float:
    """The i-th of 20 exclusive quantiles of sorted values, as in the reports."""
    n = len(values)
    if n == 1:
        return values[0]
    j = max(min(i * (n + 1) // 20, n - 1), 1)
    d = i * (n + 1) - 20 * j
    return (values[j - 1] * (20 - d) + values[j] * d) / 20


def rolling_latency(samples: DataFrame, last: int = 100) -> DataFrame:
    """A stream of (ts, event_id, backend, ms) as the count, p50 and p95 over the last samples of each
    backend that a batch has touched; a late sample counts if it is among the last. Samples without ``ms`` are dropped."""
    with_state_store(samples.sparkSession)
    own = samples.where("ms is not null").select("backend", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("bigint").alias("event_id"), F.col("ms").cast("double").alias("ms"))
    return own.groupBy("backend").transformWithState(Rolling(last), ROLLING, "Update", "None")
