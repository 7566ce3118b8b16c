"""Rate limits over an event log: attempts, admission, daily cap.

Times are whole microseconds. ``events`` has ``client``, ``t`` (bigint
microseconds) and ``event_id``; events of one instant go in the order of their
ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, new_folder, shared_dir

# Events of one block, which one task walks through.
_BLOCK_ROWS = 8_000_000

# Blocks of one key that a task may walk through in a row, times only.
_RUN_BLOCKS = 16

# Events of one slice of a client's history that one task counts.
_DENSE_SLICE = 2_000_000

SECOND = 1_000_000
DAY = 86_400 * SECOND


def as_events(df: DataFrame, client: str, ts: str, event_id: str) -> DataFrame:
    """Bring a log into the shape above; a timestamp without zone is UTC."""
    instant = F.col(ts).cast("timestamp")
    if dict(df.dtypes)[ts] != "timestamp":
        instant = F.from_utc_timestamp(instant, F.current_timezone())
    micros = F.unix_micros(instant)
    return df.select(F.col(client).alias("client"), micros.alias("t"), F.col(event_id).alias("event_id"))


# --- attempts in the trailing window ----------------------------------------


def attempts(events: DataFrame, *, window: int) -> DataFrame:
    """``(client, t, event_id, attempts)``: events of the client in
    ``(t - window, t]``. Event ids are unique.

    The history of a client is cut into slices of 4 windows; events of the last
    window of a slice are copied into the next one, which makes slices
    independent. A slice that still holds very many events is cut further, see
    :func:`_dense_attempts`.
    """
    length = 4 * window
    near_end = F.col("t") > (F.col("own") + 1) * F.lit(length) - F.lit(window)
    rows = (
        events.select("client", "t", "event_id")
        .withColumn("own", F.floor(F.col("t") / F.lit(length)).cast("bigint"))
        .select(
            "*",
            F.explode(
                F.when(near_end, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))
            ).alias("slice"),
        )
    )
    sizes = rows.groupBy("client", "slice").agg(F.count(F.lit(1)).alias("n"))
    dense = materialize(sizes.where(F.col("n") > _DENSE_SLICE).select("client", "slice"), "dense")
    if dense.isEmpty():
        return _sparse_attempts(rows, window)
    # At most one dense slice per _DENSE_SLICE rows, so the list is short.
    few = F.broadcast(dense)
    return _sparse_attempts(rows.join(few, ["client", "slice"], "left_anti"), window).unionByName(
        _dense_attempts(rows.join(few, ["client", "slice"], "left_semi"), window)
    )


def _sparse_attempts(rows: DataFrame, window: int) -> DataFrame:
    trailing = Window.partitionBy("client", "slice").orderBy("t").rangeBetween(-(window - 1), 0)
    return (
        rows.withColumn("attempts", F.count(F.lit(1)).over(trailing))
        .where("slice = own")
        .select("client", "t", "event_id", "attempts")
    )


def _dense_attempts(rows: DataFrame, window: int) -> DataFrame:
    """Attempts as the difference of two running counts, at ``t`` and at
    ``t - window``. Each count is that of the earlier buckets plus the place
    within its own bucket, and buckets are a thousandth of a window."""
    place = ["client", "slice", "bucket"]
    width = max(1, window // 1000)
    own = rows.where("slice = own")
    marks = rows.select(
        "client", "slice", "event_id", "t", F.col("t").alias("at"), F.lit(1).alias("is_event"),
        (F.col("slice") == F.col("own")).cast("int").alias("sign"),
    ).unionByName(
        own.select(
            "client", "slice", "event_id", "t", (F.col("t") - F.lit(window)).alias("at"),
            F.lit(0).alias("is_event"), F.lit(-1).alias("sign"),
        )
    ).withColumn("bucket", F.floor(F.col("at") / F.lit(width)).cast("bigint"))
    earlier = Window.partitionBy("client", "slice").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most some thousand buckets per slice.
    before = marks.groupBy(*place).agg(F.sum("is_event").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))
    ).drop("n")
    within = Window.partitionBy(*place).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("inside", F.sum("is_event").over(within)).where("sign <> 0")
    return (
        counted.join(before, place)
        .groupBy("client", "event_id", "t")
        .agg(F.sum(F.col("sign") * (F.col("before") + F.col("inside"))).alias("attempts"))
        .select("client", "t", "event_id", "attempts")
    )


# --- greedy admission -------------------------------------------------------


def admit(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Which of the sorted ``times`` are admitted after the hits ``recent``,
    and the hits (at most ``limit``) that matter later. Rejected stretches are
    skipped by binary search."""
    taken = np.zeros(len(times), dtype=bool)
    hits = list(recent)[-limit:]
    i, n = 0, len(times)
    while i < n:
        if len(hits) == limit:
            free = hits[0] + window
            if times[i] < free:
                i += int(np.searchsorted(times[i:], free, side="left"))
                continue
            hits.pop(0)
        hits.append(int(times[i]))
        taken[i] = True
        i += 1
    return taken, hits


def _walk(batches, starts: dict, carried: dict, limit: int, window: int):
    """Admit a sorted stream of Arrow batches of one block.

    ``starts`` holds hits known before the first event of a key, ``carried``
    the hits a key brings along from the previous block. Yields each batch with
    its flags, and a running summary of the block. Events of a key that never
    are more than the limit within a window are all admitted, which is seen for
    a whole batch at once; only the other keys are walked through.
    """
    state = {"first": None, "key": None, "hits": [], "last": None, "single": True, "reset": False}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        coded = batch.column("k").dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        times = batch.column("t").to_numpy()
        lo = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        hi = np.append(lo[1:], n)
        earlier = np.arange(n) - limit
        crowded = (earlier >= np.repeat(lo, hi - lo)) & (times - times[np.maximum(earlier, 0)] < window)
        walk = np.add.reduceat(crowded.astype(np.int64), lo) > 0
        walk[0] = True
        if starts:
            walk |= np.array([names[codes[i]] in starts for i in lo])
        flags = np.ones(n, dtype=bool)
        for r in np.flatnonzero(walk):
            key, part = names[codes[lo[r]]], times[lo[r] : hi[r]]
            if r == 0 and key == state["key"]:
                gap = part[0] - state["last"] >= window
            else:
                gap = False
                state["hits"] = starts.get(key, [])
                if state["key"] is None:
                    state["first"] = key
                    state["hits"] = carried.get(batch.column("block")[0].as_py(), state["hits"])
                else:
                    state["single"] = False
                state["key"] = key
            state["reset"] |= bool(gap or (len(part) > 1 and np.diff(part).max() >= window))
            flags[lo[r] : hi[r]], state["hits"] = admit(part, state["hits"], limit, window)
        if len(lo) > 1:
            state["single"] = False
        if not walk[-1]:
            state["key"] = names[codes[lo[-1]]]
            state["hits"] = times[lo[-1] :][-limit:].tolist()
        state["last"] = int(times[-1])
        yield batch, flags, state


_SUMMARY = (
    "block int, first string, last string, first_t bigint, single boolean, reset boolean, hits array<bigint>"
)


def _summarize(starts, carried, limit, window):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, block, first_t = None, None, None
        for batch, _, state in _walk(batches, starts, carried, limit, window):
            if block is None:
                block, first_t = batch.column("block")[0].as_py(), batch.column("t")[0].as_py()
        if state is not None:
            values = [
                pa.array([block], pa.int32()),
                pa.array([state["first"]]),
                pa.array([state["key"]]),
                pa.array([first_t], pa.int64()),
                pa.array([state["single"]]),
                pa.array([state["reset"]]),
                pa.array([state["hits"]], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(
                values, names=["block", "first", "last", "first_t", "single", "reset", "hits"]
            )

    return run


def _rerun(carried: dict[int, list[int]], limit: int, window: int):
    """Admit the sorted times of runs of blocks; ``carried`` holds what the
    first block of a run starts with, the others go on from the one before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, hits = None, []
        for pdf in frames:
            numbers, times = pdf["block"].to_numpy(), pdf["t"].to_numpy()
            edges = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
            for lo, hi in zip([0, *edges], [*edges, len(numbers)]):
                if lo == hi:
                    continue
                if block is not None and numbers[lo] != block:
                    yield pd.DataFrame({"block": [block], "hits": [hits]})
                if numbers[lo] != block:
                    block = int(numbers[lo])
                    hits = carried.get(block, hits)
                hits = admit(times[lo:hi], hits, limit, window)[1]
        if block is not None:
            yield pd.DataFrame({"block": [block], "hits": [hits]})

    return run


def _first_runs(chained: list[int], follows: dict[int, int], todo: set[int]) -> list[list[int]]:
    """Of each chain the first block to run, and the blocks after it."""
    runs, known, going = [], set(chained), False
    for b in chained:
        if follows[b] not in known:
            going = False  # another chain
        if not going and b in todo:
            runs.append([b])
            going = True
        elif going and len(runs[-1]) < _RUN_BLOCKS and runs[-1][-1] == follows[b]:
            runs[-1].append(b)
    return runs


def _hits_at_block_starts(blocks: DataFrame, starts: dict, limit: int, window: int) -> dict[int, list[int]]:
    """Hits that the first key of each block brings from the previous block.

    One parallel pass summarizes all blocks. The hits at the end of a block
    depend on what was brought only when the block lies inside one key and has
    no idle gap as long as the window (a client with more events than fit a
    block). Such blocks run again, all in one job, each with what the one before
    it has brought so far, until none is brought anything else than it ran with.

    Which hits a block starts with is soon forgotten: once the same events are
    admitted, all that follows is the same. So a second round mostly changes
    nothing, however many blocks a client has. Where it does (hundreds of events
    per window and few windows per block), and a round does not at least halve
    the blocks to run, nothing is gained by guessing: then the first of them runs
    with the ``_RUN_BLOCKS`` blocks after it as one stream of times.
    """
    spark = blocks.sparkSession
    rows = blocks.mapInArrow(_summarize(starts, {}, limit, window), _SUMMARY).collect()
    done = {r["block"]: r for r in sorted(rows, key=lambda r: r["block"])}
    order = list(done)
    ends = {b: list(done[b]["hits"]) for b in order}
    follows = {b: a for a, b in zip(order, order[1:]) if done[a]["last"] == done[b]["first"]}
    chained = [b for b in order if b in follows and done[b]["single"] and not done[b]["reset"]]
    ran_with: dict[int, list[int]] = {b: [] for b in chained}

    def brought(b: int) -> list[int]:
        return [h for h in ends[follows[b]] if done[b]["first_t"] - h < window]

    store, guess, before = None, True, 2 * len(chained)
    while todo := [b for b in chained if brought(b) != ran_with[b]]:
        guess = guess and 2 * len(todo) <= before
        before = len(todo)
        if store is None:
            store = new_folder(spark, "busy-clients")
            busy = blocks.where(F.col("block").isin(chained)).select("block", "t")
            busy.write.partitionBy("block").parquet(store)
        runs = [[b] for b in todo] if guess else _first_runs(chained, follows, set(todo))
        carried = {run[0]: brought(run[0]) for run in runs}
        of = F.broadcast(spark.createDataFrame([(b, run[0]) for run in runs for b in run], "block int, run int"))
        times = spark.read.parquet(store).where(F.col("block").isin([b for run in runs for b in run])).join(of, "block")
        redone = (
            times.repartition(len(runs), "run").sortWithinPartitions("run", "block", "t").select("block", "t")
            .mapInPandas(_rerun(carried, limit, window), "block int, hits array<bigint>").collect()
        )
        ends.update({r["block"]: list(r["hits"]) for r in redone})
        ran_with.update(carried)
        ran_with.update({b: brought(b) for run in runs for b in run[1:]})
    return {b: ends[a] for b, a in follows.items()}


def admitted(
    events: DataFrame,
    *,
    limit: int,
    window: int,
    keys: list[str] | None = None,
    starts: dict[str, list[int]] | None = None,
    n_blocks: int | None = None,
) -> DataFrame:
    """``(*keys, t, event_id, admitted)``: an event is admitted when fewer than
    ``limit`` admitted events of its key lie in ``(t - window, t]``.

    Events are range-partitioned by (key, time) into blocks of even size, so a
    key with a third of all events spans many blocks; the few hits that cross a
    block edge are worked out first, then all blocks run in parallel.
    ``starts`` maps a key (as JSON) to hits before its first event.
    """
    if limit < 1 or window < 1:
        raise ValueError("limit and window must be at least 1")
    keys = keys or ["client"]
    starts = starts or {}
    spark = events.sparkSession
    if n_blocks is None:
        n_blocks = max(spark.sparkContext.defaultParallelism, -(-events.count() // _BLOCK_ROWS))
    shared_dir(spark)
    shaped = events.select(F.to_json(F.struct(*keys)).alias("k"), *keys, "t", "event_id")
    blocks = (
        shaped.repartitionByRange(n_blocks, "k", "t", "event_id")
        .sortWithinPartitions("k", "t", "event_id")
        .withColumn("block", F.spark_partition_id())
        .checkpoint()
    )
    carried = _hits_at_block_starts(blocks, starts, limit, window)
    kept = [*keys, "t", "event_id"]

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flags, _ in _walk(batches, starts, carried, limit, window):
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(flags)], names=[*kept, "admitted"])

    schema = shaped.select(*kept).schema.add("admitted", "boolean")
    return blocks.mapInArrow(flag, schema)


# --- daily cap --------------------------------------------------------------

Starts = dict[int, dict[str, list[int]]]


def daily_cap(events: DataFrame, *, limit: int, window: int, cap: int) -> DataFrame:
    """``(client, t, event_id, admitted)`` under the client limit and at most
    ``cap`` admissions per UTC day.

    A rejected event is no hit, so a day is over with its ``cap``-th admission.
    All days run in parallel; then only those days run again whose hits brought
    from the days before are not the ones they ran with, until none is left.
    Per day at most ``cap`` rows take part in that.
    """
    spark = events.sparkSession
    days = events.withColumn("day", F.floor(F.col("t") / F.lit(DAY)).cast("bigint"))
    in_order = Window.partitionBy("day").orderBy("t", "event_id")
    all_days = {r["day"] for r in days.select("day").distinct().collect()}
    latest: dict[int, str] = {}
    ran_with: Starts = {}
    todo = set(all_days)
    while todo:
        part = days if todo == all_days else days.where(F.col("day").isin(sorted(todo)))
        starts = {key: hits for d in todo for key, hits in ran_with.get(d, {}).items()}
        taken = (
            admitted(part, limit=limit, window=window, keys=["day", "client"], starts=starts)
            .where("admitted")
            .withColumn("n", F.row_number().over(in_order))
            .where(F.col("n") <= cap)
            .select("day", "client", "t", "event_id")
        )
        folder = new_folder(spark, "daily-cap")
        taken.write.partitionBy("day").parquet(folder)
        latest.update(dict.fromkeys(todo, folder))
        kept = _kept(spark, latest, taken.schema)
        brought = _hits_brought(kept, limit, window)
        todo = {d for d in all_days if brought.get(d, {}) != ran_with.get(d, {})}
        ran_with = brought
    return flag_kept(events, kept)


def flag_kept(events: DataFrame, kept: DataFrame) -> DataFrame:
    """``(client, t, event_id, admitted)``: of events that are equal in all three
    as many are admitted as ``kept`` has. Ids need not be unique."""
    own = ["client", "t", "event_id"]
    all_rows = events.groupBy(*own).agg(F.count(F.lit(1)).alias("rows"))
    chosen = kept.groupBy(*own).agg(F.count(F.lit(1)).alias("kept"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own]
    counted = all_rows.alias("a").join(chosen.alias("b"), same, "left").select(
        *[f"a.{c}" for c in own], "rows", F.coalesce("kept", F.lit(0)).alias("kept")
    )
    each = counted.select(*own, "kept", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("i"))
    return each.select(*own, (F.col("i") <= F.col("kept")).alias("admitted"))


def _kept(spark, latest: dict[int, str], schema) -> DataFrame:
    """Admissions of every day from the run that day took part in last."""
    by_folder: dict[str, list[int]] = {}
    for day, folder in latest.items():
        by_folder.setdefault(folder, []).append(day)
    parts = [
        spark.read.schema(schema).parquet(folder).where(F.col("day").isin(sorted(d)))
        for folder, d in by_folder.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _hits_brought(kept: DataFrame, limit: int, window: int) -> Starts:
    """For each later day and client the last hits that still count at its start."""
    last_day = F.floor((F.col("t") + window - 1) / F.lit(DAY)).cast("bigint")
    later = kept.where(last_day > F.col("day")).select(
        F.explode(F.sequence(F.col("day") + 1, last_day)).alias("day"), "client", "t"
    )
    hits = F.sort_array(F.collect_list("t"))
    rows = (
        later.groupBy("day", "client")
        .agg(F.slice(hits, -F.least(F.size(hits), F.lit(limit)), limit).alias("hits"))
        .select("day", F.to_json(F.struct("day", "client")).alias("k"), "hits")
        .collect()
    )
    found: Starts = {}
    for r in rows:
        found.setdefault(r["day"], {})[r["k"]] = list(r["hits"])
    return found
