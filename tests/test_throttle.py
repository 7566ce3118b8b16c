import random

import pytest
from pyspark.sql import functions as F

from tamiz.operators import throttle as th
from tamiz.streaming.throttle import admitted_stream, capped_stream, clients_in_state, daily_cap_stream, timer_state


def fold(events, limit, window, cap=None):
    """One request after the other, as a server would."""
    hits, day, count, out = {}, None, 0, {}
    for client, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        if t // th.DAY != day:
            day, count = t // th.DAY, 0
        if cap is not None and count >= cap:
            out[i] = False
            continue
        recent = [h for h in hits.get(client, []) if t - h < window]
        out[i] = len(recent) < limit
        if out[i]:
            hits[client] = recent + [t]
            count += 1
    return out


def frame(spark, events):
    return spark.createDataFrame(events, "client string, t bigint, event_id bigint").repartition(5)


def log(seed, n, span, hot):
    rnd = random.Random(seed)
    return [
        ("hot" if rnd.random() < hot else f"c{rnd.randrange(20)}", rnd.randrange(span), i) for i in range(n)
    ]


# Sparse, with idle gaps, saturated without any gap, and one client only.
LOGS = [(1, 400, 100_000, 0.4), (2, 1500, 20_000, 0.5), (3, 3000, 30_000, 0.9), (4, 800, 500, 1.0)]


@pytest.mark.parametrize("seed,n,span,hot", LOGS)
@pytest.mark.parametrize("limit,window", [(1, 100), (6, 600)])
def test_admission(spark, seed, n, span, hot, limit, window):
    events = log(seed, n, span, hot)
    got = th.admitted(frame(spark, events), limit=limit, window=window, n_blocks=12).collect()
    assert {r["event_id"]: r["admitted"] for r in got} == fold(events, limit, window)
    assert {(r["client"], r["t"], r["event_id"]) for r in got} == set(events)


@pytest.mark.parametrize("span,window,most", [(400_000, 100, 2), (20_000, 1_000, 9)])
def test_busy_client_in_many_blocks(spark, monkeypatch, span, window, most):
    """Blocks that forget what they started with take two rounds; others run
    some at a time, never one job for each."""
    rounds, rerun = [], th._rerun
    monkeypatch.setattr(th, "_rerun", lambda *a: rounds.append(a[0]) or rerun(*a))
    monkeypatch.setattr(th, "_RUN_BLOCKS", 8)
    events = log(9, 8000, span, 1.0) + [("early", t, 10_000 + t) for t in range(0, span, 37)]
    got = th.admitted(frame(spark, events), limit=3, window=window, n_blocks=40).collect()
    assert {r["event_id"]: r["admitted"] for r in got} == fold(events, 3, window)
    assert 1 <= len(rounds) <= most


def test_window_is_half_open(spark):
    events = [("a", 0, 1), ("a", 59, 2), ("a", 60, 3), ("a", 60, 4)]
    got = th.admitted(frame(spark, events), limit=1, window=60, n_blocks=2).collect()
    assert {r["event_id"]: r["admitted"] for r in got} == {1: True, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("window,cap", [(3600, 7), (20 * 3600, 7), (60 * 3600, 5), (3600, 10_000)])
def test_daily_cap(spark, window, cap):
    window *= th.SECOND
    events = log(5, 300, 6 * th.DAY, 0.4)
    got = th.daily_cap(frame(spark, events), limit=2, window=window, cap=cap).collect()
    assert {r["event_id"]: r["admitted"] for r in got} == fold(events, 2, window, cap)


@pytest.mark.parametrize("dense", [2_000_000, 30, 0])
@pytest.mark.parametrize("window", [300, 5000])
def test_attempts(spark, monkeypatch, dense, window):
    monkeypatch.setattr(th, "_DENSE_SLICE", dense)
    events = log(6, 2000, 40_000, 0.5)
    got = th.attempts(frame(spark, events), window=window).collect()
    times = {}
    for c, t, _ in events:
        times.setdefault(c, []).append(t)
    assert len(got) == len(events)
    for r in got:
        assert r["attempts"] == sum(r["t"] - window < u <= r["t"] for u in times[r["client"]])


def test_utc_whatever_the_session_zone(spark):
    df = spark.sql("SELECT 'a' AS c, TIMESTAMP_NTZ '2024-01-01 00:00:07.179575' AS ts, 1 AS i")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/Santiago"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert th.as_events(df, "c", "ts", "i").first()["t"] == 1704067207179575
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def run_stream(spark, df, out, state):
    q = df.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


def test_stream_in_several_batches_equals_the_fold(spark, folder):
    span = 3 * th.DAY
    events = sorted(log(7, 600, span, 0.4), key=lambda e: e[1])
    for k in range(4):  # files in time order, one per micro-batch
        part = events[k * 150 : (k + 1) * 150]
        spark.createDataFrame(part, "client string, t bigint, event_id bigint").coalesce(1).write.mode(
            "append"
        ).parquet(f"{folder}/in")
    window = 6 * 3600 * th.SECOND
    source = (
        spark.readStream.schema("client string, t bigint, event_id bigint")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/in")
    )
    stream = admitted_stream(source, limit=2, window=window, delay=th.SECOND)
    got = run_stream(spark, stream, f"{folder}/out", f"{folder}/state")
    assert {r["event_id"]: r["admitted"] for r in got.collect()} == fold(events, 2, window)
    assert not any(r["late"] for r in got.collect())

    second = spark.readStream.schema(got.schema).parquet(f"{folder}/out")
    daily_cap_stream(second, f"{folder}/capped", cap=20).trigger(availableNow=True).start().awaitTermination()
    capped = spark.read.parquet(f"{folder}/capped/flags")
    admitted = sorted((t, i) for (c, t, i) in events if fold(events, 2, window)[i])
    want, per_day = {}, {}
    for t, i in admitted:
        per_day[t // th.DAY] = per_day.get(t // th.DAY, 0) + 1
        want[i] = per_day[t // th.DAY] <= 20
    assert {r["event_id"]: r["admitted"] for r in capped.collect()} == want


def test_late_events_are_flagged_not_dropped(spark, folder):
    parts = [[("a", 100, 1), ("b", 50, 2)], [("a", 40, 3), ("a", 95, 4), ("a", 130, 5), ("b", 51, 6)], [("a", 131, 7)]]
    for part in parts:
        spark.createDataFrame(part, "client string, t bigint, event_id bigint").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema("client string, t bigint, event_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = run_stream(spark, admitted_stream(source, limit=2, window=50, delay=10), f"{folder}/out", f"{folder}/state")
    flags = {r["event_id"]: (r["admitted"], r["late"]) for r in got.collect()}
    # 3 is late; 4 is behind by less than the delay and a hit; 5 finds 95 and 100.
    assert flags == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), 5: (False, False), 6: (True, False), 7: (False, False)}


def test_ids_need_not_be_unique(spark):
    rows = [("a", 10, 1), ("b", 20, 1), ("a", 30, 2), ("a", 30, 2), (None, 5, None)]
    events = spark.createDataFrame(rows, "client string, t bigint, event_id bigint")
    got = th.daily_cap(events, limit=2, window=1000, cap=3).collect()
    assert len(got) == len(rows) and sum(r["admitted"] for r in got) == 3
    kept = spark.createDataFrame([("a", 30, 2)], events.schema)
    flagged = sorted((tuple(r) for r in th.flag_kept(events, kept).collect()), key=repr)
    assert flagged == sorted([(*r, False) for r in rows[:3]] + [("a", 30, 2, True), (None, 5, None, False)], key=repr)


def run_capped(spark, folder, parts, idle_ms=None, **options):
    """Each part is a file and a micro-batch of its own."""
    schema = "client string, t bigint, event_id bigint"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = capped_stream(source, idle_ms=idle_ms, **options)
    with timer_state(spark, until_read=True):
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        q.outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_both_stages_in_one_stream(spark, folder):
    events = sorted(log(12, 800, 3 * th.DAY, 0.4), key=lambda e: (e[1], e[2]))
    window = 6 * 3600 * th.SECOND
    got = run_capped(spark, folder, [events[i : i + 200] for i in range(0, 800, 200)], limit=2, window=window, cap=20, delay=th.SECOND)
    got = {r["event_id"]: (r["within_limit"], r["admitted"], r["late"]) for r in got.collect()}
    within, per_day, want = fold(events, 2, window), {}, {}
    for _, t, i in events:
        per_day[t // th.DAY] = per_day.get(t // th.DAY, 0) + within[i]
        want[i] = (within[i], within[i] and per_day[t // th.DAY] <= 20, False)
    assert got == want


def test_state_of_idle_clients_goes(spark, folder):
    import time

    run_capped(spark, folder, [[("a", 1, 1), ("b", 2, 2)]], idle_ms=500, limit=1, window=10, cap=5)
    assert sorted(r[0] for r in clients_in_state(spark, f"{folder}/state").collect()) == ["a", "b"]
    time.sleep(0.6)
    got = run_capped(spark, folder, [[("c", 3, 3)]], limit=1, window=10, cap=2)
    assert [r[0] for r in clients_in_state(spark, f"{folder}/state").collect()] == ["c"]
    # The day's count stays longer than a client's hits.
    assert {r["event_id"]: r["admitted"] for r in got.collect()} == {1: True, 2: True, 3: False}
