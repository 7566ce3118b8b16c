"""The client limit and the daily cap over an event stream.

:func:`capped_stream` does both in one query, as two stateful steps with timers.
:func:`admitted_stream` and :func:`daily_cap_stream` are the same as two
queries, the first of which also works without RocksDB as its state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.throttle import DAY, admit, flag_kept

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Lanes in which a day's rejected events pass the second step of
#: :func:`capped_stream`; they need no state, so they need not come together.
_LANES = 64


def decide(rows: pd.DataFrame, hits: list[int], newest: int | None, limit: int, window: int, delay: int):
    """The client limit on one client's events of a micro-batch, given its hits
    and newest time so far. Returns (rows in order, admitted, late, hits,
    newest)."""
    rows = rows.sort_values(["t", "event_id"])
    t = rows["t"].to_numpy()
    late = np.zeros(len(t), bool) if newest is None else t < newest - delay
    flags = np.zeros(len(t), bool)
    behind = np.flatnonzero(~late & (t < newest)) if newest is not None else np.zeros(0, np.int64)
    for i in behind:
        if sum(t[i] - window < h <= t[i] for h in hits) < limit:
            flags[i] = True
            hits = sorted([*hits, int(t[i])])
    ahead = ~late
    ahead[behind] = False
    # Hits that one behind may still have to be compared with are kept.
    start = [h for h in hits if not ahead.any() or h > t[ahead][0] - window][-limit:]
    flags[ahead], _ = admit(t[ahead], start, limit, window) if ahead.any() else (flags[ahead], None)
    newest = int(max(t.max(), newest if newest is not None else t.max()))
    hits = sorted([*hits, *t[ahead & flags].tolist()])
    return rows, flags, late, [int(h) for h in hits if h > newest - delay - window], newest


def admitted_stream(events: DataFrame, *, limit: int, window: int, delay: int = 0) -> DataFrame:
    """``(client, t, event_id, admitted, late)`` for a stream in the shape of
    the batch form: ``client``, ``t`` (microseconds) and ``event_id``.

    Events of one micro-batch are put in time order. An event more than
    ``delay`` microseconds before the newest one of its client in earlier
    batches is late: it is in the result, not admitted, and no hit. One that is
    behind by less is decided by the hits in its own trailing window. No event
    is dropped, so the result does not depend on how large batches are as long
    as they follow time.

    State per client is its last hits and its newest time; it goes when nothing
    of the client has arrived for the window and the delay. That is measured by
    the time of arrival: a watermark on the events' own time would drop late
    ones.
    """
    client_type = events.schema["client"].dataType.simpleString()
    id_type = events.schema["event_id"].dataType.simpleString()
    idle_ms = (window + delay) // 1000 + 1

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits, newest = ([int(h) for h in state.get[0]], int(state.get[1])) if state.exists else ([], None)
        rows, flags, late, hits, newest = decide(pd.concat(list(batches)), hits, newest, limit, window, delay)
        state.update((hits, newest))
        arrived = int(rows["arrived"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(arrived, state.getCurrentWatermarkMs()) + idle_ms)
        yield rows[["client", "t", "event_id"]].assign(admitted=flags, late=late)

    return (
        events.select("client", "t", "event_id", F.current_timestamp().alias("arrived"))
        .withWatermark("arrived", "0 seconds")
        .groupBy("client")
        .applyInPandasWithState(
            step,
            f"client {client_type}, t bigint, event_id {id_type}, admitted boolean, late boolean",
            "hits array<bigint>, newest bigint",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def cap_batch(admissions: DataFrame, used: DataFrame, *, cap: int) -> tuple[DataFrame, DataFrame]:
    """The daily cap on one micro-batch of admitted events: the events with
    ``admitted``, and the new count per day.

    ``used`` has ``day`` and ``n``, the admissions of earlier batches. Only the
    first ``cap`` events of a day can count, so that each task passes on no more
    of a busy day, and the days of a batch are few. Unlike the batch form,
    events beyond the cap still count as hits of their client.
    """
    rows = admissions.where("admitted").select("client", "t", "event_id", F.floor(F.col("t") / F.lit(DAY)).cast("bigint").alias("day"))
    order = Window.partitionBy("day").orderBy("t", "event_id")
    first = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= cap)
    counted = first.join(used.select("day", F.col("n").alias("before")), "day", "left")
    kept = counted.where(F.col("i") + F.coalesce("before", F.lit(0)) <= cap)
    now = kept.groupBy("day").agg(F.count(F.lit(1)).alias("n")).unionByName(used.select("day", "n"))
    return flag_kept(rows, kept), now.groupBy("day").agg(F.sum("n").alias("n"))


def daily_cap_stream(admissions: DataFrame, folder: str, *, cap: int):
    """Start the second stage: it reads what :func:`admitted_stream` wrote and
    writes ``(client, t, event_id, admitted)`` to ``folder/flags``, batch by
    batch; the counts per day after a batch are in ``folder/days``. A batch that
    is tried again replaces what its first try wrote. Returns the writer to be
    given a trigger and started."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "day bigint, n bigint"
        used = spark.read.schema(schema).parquet(f"{folder}/days/batch={number - 1}") if number else spark.createDataFrame([], schema)
        flags, days = cap_batch(batch, used, cap=cap)
        flags.write.mode("overwrite").parquet(f"{folder}/flags/batch={number}")
        days.write.mode("overwrite").parquet(f"{folder}/days/batch={number}")

    return admissions.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")


@contextmanager
def timer_state(spark: SparkSession, *, until_read: bool = False):
    """Queries started inside keep their state in RocksDB, as timers need.

    With timers a stream goes on with batches without data, so that they fire.
    ``until_read`` leaves these out: a query that is to end once it has read all
    there is (trigger ``availableNow``) would never end otherwise."""
    wanted = {_PROVIDER: _ROCKSDB} | ({_NO_DATA_BATCHES: "false"} if until_read else {})
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class _Expiring(StatefulProcessor):
    """State of a key that goes when nothing has arrived for ``idle_ms``."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def stay(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class _ClientLimit(_Expiring):
    """First step, by client: its last hits and its newest time."""

    def __init__(self, limit: int, window: int, delay: int, idle_ms: int):
        super().__init__(idle_ms)
        self.limit, self.window, self.delay = limit, window, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "hits array<bigint>, newest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        hits, newest = ([int(h) for h in held[0]], int(held[1])) if held else ([], None)
        own, flags, late, hits, newest = decide(pd.concat(list(rows)), hits, newest, self.limit, self.window, self.delay)
        self.held.update((hits, newest))
        self.stay(timerValues)
        yield own[["client", "t", "event_id"]].assign(within_limit=flags, late=late)


class _DayCap(_Expiring):
    """Second step, by day: how many of it were admitted. Of the events within
    the limit that a micro-batch brings, the first ones fill what is left; no
    more than ``cap`` are held at once."""

    def __init__(self, cap: int, idle_ms: int):
        super().__init__(idle_ms)
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["client", "t", "event_id", "within_limit", "late"]
        if key[1]:
            for pdf in rows:
                yield pdf[columns].assign(admitted=False)
            return
        used = int(self.held.get()[0]) if self.held.exists() else 0
        room, first = self.cap - used, None
        for pdf in rows:
            pdf = pdf[columns] if first is None else pd.concat([first, pdf[columns]])
            pdf = pdf.sort_values(["t", "event_id"], kind="stable")
            first = pdf.head(room)
            if len(pdf) > len(first):
                yield pdf.iloc[room:].assign(admitted=False)
        self.held.update((used + len(first),))
        self.stay(timerValues)
        if len(first):
            yield first.assign(admitted=True)


def capped_stream(
    events: DataFrame, *, limit: int, window: int, cap: int, delay: int = 0, idle_ms: int | None = None
) -> DataFrame:
    """``(client, t, event_id, within_limit, late, admitted)``: the client limit,
    as :func:`admitted_stream` decides it, and of the events within it the first
    ``cap`` of a UTC day, in the order of (micro-batch, time, id). As with two
    queries, an event beyond the cap still counts as a hit of its client.

    Two stateful steps, by client and by day, run in one query with one
    checkpoint; start it inside :func:`timer_state`. Timers remove a client's
    state when nothing of it has arrived for the window and the delay, or for
    ``idle_ms`` if given, and a day's after a day more.
    """
    client_type = events.schema["client"].dataType.simpleString()
    id_type = events.schema["event_id"].dataType.simpleString()
    idle = (window + delay) // 1000 + 1 if idle_ms is None else idle_ms
    own = f"client {client_type}, t bigint, event_id {id_type}, within_limit boolean, late boolean"
    decided = (
        events.select("client", "t", "event_id")
        .groupBy("client")
        .transformWithStateInPandas(_ClientLimit(limit, window, delay, idle), own, "append", "processingTime")
    )
    lane = F.when(F.col("within_limit"), 0).otherwise(1 + F.pmod(F.xxhash64("event_id", "t"), F.lit(_LANES)))
    day = F.floor(F.col("t") / F.lit(DAY)).cast("bigint")
    return (
        decided.withColumns({"day": day, "lane": lane.cast("int")})
        .groupBy("day", "lane")
        .transformWithStateInPandas(_DayCap(cap, idle + DAY // 1000), f"{own}, admitted boolean", "append", "processingTime")
    )


def clients_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(client)``: those of which the checkpoint of a :func:`capped_stream`
    still holds state, as Spark's state source tells."""
    held = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "held").load(checkpoint)
    return held.select(F.col("key.client").alias("client"))
