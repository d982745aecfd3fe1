"""Keyed state in event-time order: what comes out does not depend on how the input is cut into micro-batches.

`InOrder` keeps the rows of a shard of keys until the watermark has passed them, takes those of each key in (time, id) order through a rule, and lets the
rule's state end at a time of its own (a timer, so state goes when it is over). A row that comes later than the watermark's delay is
dropped, as in every Spark stream. State is kept in RocksDB. Rules are small objects with

* `step(key, state, row)`: (new state, rows out, rows to come at a later time), state None if there is none;
* `ends(state)`: the microsecond at which the state is over, or None;
* `ended(key, state)`: rows out when it is.

Rows are (us, id, ...), states tuples of longs or doubles.
"""

from __future__ import annotations

import contextlib
import heapq
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memloom.sources.session import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = "2250-01-01 00:00:00"  # beyond all events: the watermark of a stream that is over


class InOrder(StatefulProcessor):
    """A group is a shard of the keys: its rows wait in one list, its keys' states lie in another, so what is asked of the state store grows with the shards and not
    with the keys. `key__`, last of a row and first of a state, tells them apart."""

    def __init__(self, rule, row: str, state: str, out: list[str], names: list[str]):
        self.rule, self.row, self.state, self.out, self.names = rule, f"{row}, key__ string", f"key__ string, {state}", out, [*names, "key__"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.row)
        self.kept = handle.getListState("kept", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest, upto = None, timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["id"].notna() & (pdf["us"] // 1000 > upto)]  # not the end, and not too late
            given = [tuple(r) for r in pdf[self.names].itertuples(index=False)]
            given = [tuple(int(v) if i < 2 else v for i, v in enumerate(r)) for r in given]
            if given:
                self.pending.appendList(given)
                soonest = min([r[0] for r in given] + ([] if soonest is None else [soonest]))
        if soonest is not None:
            self.handle.registerTimer(soonest // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        states = {r[0]: tuple(r)[1:] for r in self.kept.get()} if self.kept.exists() else {}
        due: dict[str, list[tuple]] = {k: [] for k in states}
        later: list[tuple] = []
        for r in self.pending.get() if self.pending.exists() else []:
            (due.setdefault(r[-1], []) if r[0] // 1000 <= upto else later).append(tuple(r))
        out: list[tuple] = []
        for k, rows in due.items():
            states[k] = self._taken(k, states.get(k), rows, upto, later, out)
        states = {k: s for k, s in states.items() if s is not None}
        self.pending.put(later) if later else self.pending.clear()
        self.kept.put([(k, *s) for k, s in states.items()]) if states else self.kept.clear()
        ends = [e for e in map(self.rule.ends, states.values()) if e is not None]
        if later or ends:
            self.handle.registerTimer(min([r[0] for r in later] + ends) // 1000)
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def _taken(self, key: str, state: tuple | None, due: list[tuple], upto: int, later: list[tuple], out: list[tuple]) -> tuple | None:
        """The state of a key after its rows that are due, and what is over by then."""
        found: list[tuple] = []
        heapq.heapify(due)
        while due:
            row = heapq.heappop(due)
            state = self._over(key, state, row[0], found)
            state, rows, more = self.rule.step(key, state, row[:-1])
            found += rows
            for r in more:
                heapq.heappush(due, (*r, key)) if r[0] // 1000 <= upto else later.append((*r, key))
        state = self._over(key, state, upto * 1000 + 999, found)
        out += [(key, *r) for r in found]
        return state

    def _over(self, key, state: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        if state is not None and self.rule.ends(state) is not None and self.rule.ends(state) <= now:
            out += self.rule.ended(key, state)
            return None
        return state

    def close(self) -> None:
        pass


SHARDS, ROWS = 64, 10_000  # fewest shards, and rows of a table to each


def shards(rows: DataFrame) -> int:
    """Over how many shards the keys of a table's stream are dealt: a worker holds the waiting rows of one shard, so their number goes with the table."""
    return max(SHARDS, -(-rows.count() // ROWS))


def in_order(events: DataFrame, keys: list[str], rule, row: str, state: str, out: str, delay: str = "1 hour", dealt: int = SHARDS) -> DataFrame:
    """events (ts, id, `keys` and the columns that `row` names after `us long, id long`) through a rule; out: the columns after the keys, which are strings or whole numbers.
    dealt: the number of shards, which is fixed for the life of a checkpoint."""
    names = [c.split()[0] for c in row.split(",")]
    key_types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    given = events.withWatermark("ts", delay).select("ts", F.pmod(F.xxhash64(*keys), F.lit(dealt)).alias("shard__"), F.unix_micros("ts").alias("us"), *[c for c in names if c != "us"], key.alias("key__"))
    schema = f"key__ string, {out}"
    columns = [c.split()[0] for c in schema.split(", ")]
    processor = InOrder(rule, row, state, columns, names)
    made = given.groupBy("shard__").transformWithStateInPandas(processor, schema, "append", "EventTime")
    return made.withColumn("key__", F.from_json("key__", key_types)).select("key__.*", *columns[1:])


class Once:
    """The rows that find no live record of their key and make one, which lives `seconds` (an idempotency record, a cooldown)."""

    def __init__(self, seconds: int):
        self.us = seconds * 1_000_000

    def step(self, key, state, row):
        return (state, [], []) if state is not None else ((row[0],), [(row[1],)], [])

    def ends(self, state):
        return state[0] + self.us

    def ended(self, key, state):
        return []


class Counted:
    """Rows of a key since its last pause of more than `seconds`: the record is renewed by each row."""

    def __init__(self, seconds: int):
        self.us = seconds * 1_000_000

    def step(self, key, state, row):
        n = 1 if state is None else state[1] + 1
        return (row[0], n), [(row[1], n)], []

    def ends(self, state):
        return state[0] + self.us + 1

    def ended(self, key, state):
        return []


class Sessions:
    """A row for each session when it is over: `seconds` without a row of the key."""

    def __init__(self, seconds: int):
        self.us = seconds * 1_000_000

    def step(self, key, state, row):
        return ((row[0], row[0], 1) if state is None else (state[0], row[0], state[2] + 1)), [], []

    def ends(self, state):
        return state[1] + self.us

    def ended(self, key, state):
        return [(state[0], state[1], state[2])]


class Walk:
    """x goes to clip(mult * x + add); a row for each step. The state is a person's score and does not end."""

    def __init__(self, low: float, high: float, start: float):
        self.low, self.high, self.begin = low, high, start

    def step(self, key, state, row):
        x = self.begin if state is None else state[0]
        x = min(self.high, max(self.low, row[2] * x + row[3]))
        return (x,), [(row[1], x)], []

    def ends(self, state):
        return None

    def ended(self, key, state):
        return []


class Polls:
    """A queue that is polled every `tick` seconds for its first `most` rows: the poll that takes each row. A poll takes what came
    up to its own time. The state, last poll and how many it took, is over when the next poll is due and nothing waits."""

    def __init__(self, tick: int = 30, most: int = 100):
        self.us, self.most = tick * 1_000_000, most

    def step(self, key, state, row):
        poll = -(-row[0] // self.us)
        last, taken = state or (-1, 0)
        if poll < last or (poll == last and taken >= self.most):
            poll = last if taken < self.most else last + 1
        taken = taken + 1 if poll == last else 1
        return (poll, taken), [(row[1], poll)], []

    def ends(self, state):
        return (state[0] + 1) * self.us

    def ended(self, key, state):
        return []


# Retries, base of the backoff in seconds.
RETRIES, BASE = 5, 2


class Attempts:
    """The outbox state machine. A row is (us, id, fails, kind, attempt): an event that fails `fails` times, when extracted (kind 0) or when
    written (kind 1). A failure waits BASE ** attempt seconds, up to RETRIES times; then a failed extraction goes to review and a failed write to the dead letters."""

    def step(self, key, state, row):
        us, event, fails, kind, attempt = row
        if fails <= attempt:
            return None, [(event, attempt, "done", us)], []
        if attempt < RETRIES:
            return None, [(event, attempt, "retry", us)], [(us + BASE**attempt * 1_000_000, event, fails, kind, attempt + 1)]
        return None, [(event, attempt, "dlq" if kind else "pending_review", us)], []

    def ends(self, state):
        return None

    def ended(self, key, state):
        return []


# ---- replay of a table -----------------------------------------------------------------------------
@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside is kept in RocksDB."""
    had = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, had) if had else spark.conf.unset(PROVIDER)


def replayed(rows: DataFrame, build: Callable[[DataFrame], DataFrame], batches: list[str] | int = 3, name: str = "replay", sink: Callable[[str], Callable] | None = None) -> DataFrame:
    """What a stream makes of a table (with `ts timestamp` and `id`) that comes in parts and then ends.

    batches: so many equal spans of ts, or a predicate for each part. A last part holds one row without id at END, so that the watermark passes all others.
    Parts are files in the shared folder, taken one a trigger; the stream runs once over all of them. sink: makes, for a folder, a foreachBatch function
    that writes there; the result then has the folder as `_path` and no rows."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
    if isinstance(batches, int):
        lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
        cuts = [] if lo is None else [lo + (hi - lo) * i // batches for i in range(1, batches)]
        at = F.unix_micros("ts")
        batches = [(F.lit(True) if i == 0 else at > cuts[i - 1]) & (F.lit(True) if i == len(cuts) else at <= cuts[i]) for i in range(len(cuts) + 1)]
    for i, part in enumerate(batches):
        rows.where(part).coalesce(1).write.parquet(f"{path}/in/part={i}")
    end = spark.range(1).select(*[(F.lit(END).cast("timestamp") if f.name == "ts" else F.lit(None if f.name == "id" else _blank(f)).cast(f.dataType)).alias(f.name) for f in rows.schema])
    end.write.parquet(f"{path}/in/part={len(batches)}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/part=*")
    out = build(stream)
    with rocks(spark):
        to = out.writeStream.foreachBatch(sink(f"{path}/out")) if sink else out.writeStream.format("parquet").option("path", f"{path}/out")
        query = to.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.createDataFrame([], out.schema) if sink else spark.read.schema(out.schema).parquet(f"{path}/out")
    got._path, got._progress = f"{path}/out", query.recentProgress
    return got


def _blank(field):
    """A value for a key of the closing row: no key may be null."""
    return "" if field.dataType.simpleString() == "string" else -1
