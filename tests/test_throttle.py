import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from docloom.streaming import refresh


def greedy(rows, gap):
    out, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        ok = k not in last or (t - last[k]).total_seconds() >= gap
        out[i] = ok
        if ok:
            last[k] = t
    return out


@pytest.mark.parametrize("keys", [[1], [1, None, 2, 3], list(range(200))])
def test_a_key_spans_tasks(spark, keys):
    rng = random.Random(len(keys))
    start = datetime(2024, 1, 1)
    rows = [(rng.choice(keys), start + timedelta(seconds=rng.randrange(0, 3_000_000) if i % 7 else 500_000), i) for i in range(6000)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long").repartition(5)
    for k in ("spark.sql.adaptive.coalescePartitions.enabled",):
        spark.conf.set(k, "false")
    try:
        for gap in (1800, 60, 400_000):
            got = {r["event_id"]: r["accepted"] for r in refresh.throttle(events, "user_id", "ts", gap).collect()}
            assert got == greedy(rows, gap)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_passages_compose():
    rng = np.random.default_rng(1)
    for _ in range(300):
        times = np.sort(rng.integers(0, 200, rng.integers(2, 60)))
        gap, cut = int(rng.integers(1, 80)), int(rng.integers(1, len(times)))
        last = refresh.accepted(times[:cut], None, gap)[1]
        until, after = refresh.passage(times[cut:], gap)
        at = refresh.bisect_left(until, last)
        assert (after[at] if at < len(until) else last) == refresh.accepted(times, None, gap)[1]


def test_triggers_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    times = sorted(rng.randrange(0, 400_000) for _ in range(400))
    rows = [(rng.randrange(6), start + timedelta(seconds=t), i) for i, t in enumerate(times)]
    schema = "user_id long, ts timestamp, event_id long"
    for k in range(5):
        spark.createDataFrame(rows[k * 80 : (k + 1) * 80], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([(99, start + timedelta(days=30), 999)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/5")  # time goes on
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        found = refresh.trigger_stream(stream, "user_id", "ts", 1800, 10_800)
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    got = spark.read.parquet(f"{tmp_path}/out").where("user_id < 99").collect()
    events = spark.createDataFrame(rows, schema)
    assert sorted(r["event_id"] for r in got if r["reason"] == "change") == sorted(r["event_id"] for r in refresh.throttle(events, "user_id", "ts").where("accepted").collect())
    due = {r["event_id"]: r["due"] for r in refresh.needs_fallback(events, "user_id", "ts").collect()}
    assert len(due) == sum(r["reason"] == "fallback" for r in got)
    assert {r["event_id"]: r["at"] for r in got if r["reason"] == "fallback"} == due


def test_neighbours_across_ranges(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), start + timedelta(seconds=rng.randrange(0, 900_000)), i, rng.randrange(1, 4000)) for i in range(3000)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, n int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        due = {r["event_id"] for r in refresh.needs_fallback(events, "user_id", "ts", 2000).collect()}
        runs = events.selectExpr("event_id AS run_id", "user_id AS target", "ts AS started", "ts + make_interval(0, 0, 0, 0, 0, 0, n) AS ended")
        busy = {r["run_id"]: r["busy_until"] for r in refresh.overlapping(runs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want_due, want_busy = set(), {}
    for k in (1, 2, None):
        own = sorted((t, i, n) for u, t, i, n in rows if u == k)
        until = None
        for (t, i, n), after in zip(own, [*own[1:], None], strict=True):
            if after is None or after[0] > t + timedelta(seconds=2000):
                want_due.add(i)
            if until is not None and t < until:
                want_busy[i] = until
            until = max(until or t, t + timedelta(seconds=n))
    assert due == want_due and busy == want_busy
