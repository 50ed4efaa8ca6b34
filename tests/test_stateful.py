import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.streaming import stateful

EPOCH = datetime(2024, 1, 1)
EVENTS = "ts timestamp_ntz, event_id long, kind string, path string, folder string"


def simulated(events, delay, by):
    """Event by event: one timer a scope, started by the first pending event, not put off by others."""
    flushed, pending, due = [], {}, {}
    for ts, event_id, kind, path, folder in sorted(events):
        scope = folder if by else path
        if scope in due and ts >= due[scope]:
            flushed += [(scope, p, k, n, first, due[scope]) for p, (k, n, first) in pending.pop(scope).items()]
            del due[scope]
        due.setdefault(scope, ts + timedelta(seconds=delay))
        k = pending.setdefault(scope, {}).get(path)
        pending[scope][path] = (kind, k[1] + 1 if k else 1, k[2] if k else ts)
    return flushed, {s: [(s, p, k, n, first, due[s]) for p, (k, n, first) in own.items()] for s, own in pending.items()}


def made(n, start, seed):
    rng = random.Random(seed)
    return [(EPOCH + timedelta(seconds=start, microseconds=rng.randrange(60_000_000)), seed * 1000 + i, rng.choice(["changed", "deleted"]), f"/f{k % 2}/p{k}", f"/f{k % 2}") for i, k in enumerate(rng.choices(range(8), k=n))]


def run(spark, tmp_path, build, batches, mode):
    """Each batch by a query of its own on the same checkpoint: state outlives restarts."""
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        out = []
        query = build(stream).writeStream.foreachBatch(lambda b, n, out=out: out.extend(map(tuple, b.collect()))).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        yield out


def test_debounced_equals_the_simulation(spark, tmp_path):
    for by in (None, "folder"):
        batches = [made(60, 60 * k, k + 1) for k in range(3)] + [[(EPOCH + timedelta(days=1), 9, "changed", "/end", "/end")]]
        got = [r for out in run(spark, tmp_path / str(by), lambda s, by=by: stateful.debounced(s, 2.0, by), batches, "append") for r in out]
        flushed, left = simulated([e for b in batches for e in b], 2.0, by)
        wanted = flushed + [r for scope, rows in left.items() if scope != "/end" for r in rows]
        assert sorted(got) == sorted(wanted) and len(wanted) > 20


class Counted:
    """State in a dict that counts the calls to it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "getMapState": lambda *_: self, "getValueState": lambda *_: self.due, "containsKey": self.held.__contains__, "getValue": self.held.get, "updateValue": self.held.__setitem__,
                "iterator": lambda: iter(list(self.held.items())), "clear": self.held.clear, "get": lambda: self.held.get(0), "update": lambda v: self.held.__setitem__(0, v), "exists": lambda: 0 in self.held, "registerTimer": lambda *_: None, "deleteTimer": lambda *_: None,
            }[name](*args)

        return call


def test_calls_to_the_state_grow_with_paths_not_with_rows():
    from pyspark.sql import Row

    own = stateful.Debounce(2000)
    state = Counted()
    state.due = Counted()
    own.init(state)
    state.calls = 0
    rows = [Row(at=i * 100_000, event_id=i, kind="changed", path=f"p{i % 3}") for i in range(1000)]
    out = [r for part in (rows[:700], rows[700:]) for r in own.handleInputRows(("s",), iter(part), None)]
    assert state.calls + state.due.calls < 40
    assert sum(r.n for r in out) + sum(n for _, n, _ in state.held.values()) == 1000 and len(out) == 49 * 3


def test_rolling_latency_equals_the_report(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(EPOCH + timedelta(seconds=1000 * k + i), 1000 * k + i, rng.choice("abc"), str(rng.random() * 100), "") for i in range(n)] for k, n in enumerate((5, 150, 40))]
    known, seen = {}, []
    for rows, out in zip(batches, run(spark, tmp_path, lambda s: stateful.rolling_latency(s.select("ts", "event_id", F.col("kind").alias("backend"), F.col("path").cast("double").alias("ms")), 20), batches, "update"), strict=True):
        seen += rows
        known |= {r[0]: r for r in out}
        samples = spark.createDataFrame([(r[0], r[1], r[2], float(r[3])) for r in seen], "ts timestamp_ntz, event_id long, backend string, ms double")
        wanted = {r.backend: (r.backend, r.n, r.p50, r.p95) for r in reports.latency(samples, 20, "backend").collect()}
        assert {b: (b, n, round(p50, 1), round(p95, 1)) for b, n, p50, p95 in known.values()} == wanted
