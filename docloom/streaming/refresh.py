"""Refresh: throttled triggers, overlap of runs, and an incremental stream of new files."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.tables import Write, carried, ranged, with_carried, written

MIN_GAP_S = 1800
FALLBACK_S = 3 * 3600


def key_runs(keys: pa.Array) -> list[int]:
    """Where the runs of equal keys begin, and the end."""
    if not len(keys):
        return [0]
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]


def accepted(times: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """The places of sorted times that are accepted after the last accepted one, and the last one then."""
    at, out = 0 if last is None else int(np.searchsorted(times, last + gap)), []
    while at < len(times):
        out.append(at)
        last = int(times[at])
        at = int(np.searchsorted(times, last + gap))
    return out, last


def passage(times: np.ndarray, gap: int) -> tuple[list[int], list[int]]:
    """What sorted times do to the last accepted time before them: (until, after), up to ``until[i]`` it becomes ``after[i]``; beyond, it stays.

    Only the rows of one gap can be the first accepted; their chains are followed together, and mostly meet.
    """
    following = np.searchsorted(times, times + gap)
    first = np.arange(min(len(times), int(following[0]) + 1))
    at = first
    while (more := following[at] < len(times)).any():
        at = np.where(more, following[at], at)
    after = times[at]
    ends = np.append(np.flatnonzero(np.diff(after)), len(first) - 1)  # the chains that meet are one
    return (times[first[ends]] - gap).tolist(), after[ends].tolist()


def throttle(events: DataFrame, key: str, ts: str, min_gap_s: int = MIN_GAP_S, write: Write = written) -> DataFrame:
    """events with ``accepted``: at least the gap after the last accepted event of the key (greedy, in order of time and event_id).

    Events are dealt to ranges of (key, time), so a key spans as many tasks as it needs. Each range says what it does to the last
    accepted time of the key that comes in from the range before (``passage``); these summaries, one a range and at most as long as
    a gap has events, are composed in order, and then each range is flagged from the time it begins with. Rows that repeat each keep
    a flag of their own.
    """
    names, gap = events.columns, min_gap_s * 1_000_000
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    rows = events.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "_micros": F.unix_micros(F.col(ts).cast("timestamp"))})
    ranged = rows.repartitionByRange("_key", "_micros", "event_id").sortWithinPartitions("_key", "_micros", "event_id")
    lying = write(ranged.withColumns({"_part": F.spark_partition_id(), "_number": F.monotonically_increasing_id()}))
    dealt = lambda *columns: lying.select(*columns, "_part", "_key", "_micros", "_number").repartition("_part").sortWithinPartitions("_number")

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        return tuple(b.column(b.num_columns - 4 + i) if i == 1 else b.column(b.num_columns - 4 + i).to_numpy(zero_copy_only=False) for i in range(3))

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray]]:
        """(part, key, times) of each run; a run that batches cut comes in pieces."""
        for b in it:
            parts, keys, times = columns(b)
            edges = sorted({*key_runs(keys), *(np.flatnonzero(np.diff(parts)) + 1).tolist()})
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield int(parts[lo]), keys[lo].as_py(), times[lo:hi]

    def summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, dict] = {}
        pieces: list[np.ndarray] = []
        for part, k, times in runs(it):
            if part not in out:
                pieces = []
            own = out.setdefault(part, {"first": k, "last": k, "until": [], "after": [], "end": None})
            if k != own["last"]:
                own["last"], own["end"] = k, None
            if k == own["first"]:
                pieces.append(times)
                own["until"], own["after"] = [], []
                own["head"] = pieces
            own["end"] = accepted(times, own["end"], gap)[1]
        for own in out.values():
            own["until"], own["after"] = passage(np.concatenate(own.pop("head")), gap)
        if out:
            yield pa.RecordBatch.from_pylist([{"part": p, **own} for p, own in out.items()], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("until", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("end", pa.int64())]))

    begins: dict[int, int] = {}
    before: tuple[str, int] | None = None
    for r in sorted(dealt().mapInArrow(summaries, "part int, first string, last string, until array<long>, after array<long>, end long").collect(), key=lambda r: r["part"]):  # a row for each range
        last = r["end"]
        if before is not None and before[0] == r["first"]:
            begins[r["part"]] = before[1]
            at = bisect_left(r["until"], before[1])
            if r["first"] == r["last"]:
                last = r["after"][at] if at < len(r["until"]) else before[1]
        before = (r["last"], last)

    def flags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = state_key = last = None
        for b in it:
            parts, keys, times = columns(b)
            found = np.zeros(b.num_rows, bool)
            edges = sorted({*key_runs(keys), *(np.flatnonzero(np.diff(parts)) + 1).tolist()})
            for lo, hi in zip(edges, edges[1:], strict=False):
                k = keys[lo].as_py()
                if int(parts[lo]) != part:
                    part, state_key, last = int(parts[lo]), k, begins.get(int(parts[lo]))
                elif k != state_key:
                    state_key, last = k, None
                hits, last = accepted(times[lo:hi], last, gap)
                found[lo + np.array(hits, np.int64)] = True
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found)], [*names, "accepted"])

    return dealt(*names).mapInArrow(flags, f"{schema}, accepted boolean")


def throttle_stream(events: DataFrame, key: str, ts: str, min_gap_s: int = MIN_GAP_S) -> DataFrame:
    """The same over a stream, with the last accepted time as the state of a key: (key, event_id, ts) of accepted events."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values([ts, "event_id"])  # one micro-batch of a key
        out = []
        for i, t in zip(rows["event_id"], rows[ts], strict=True):
            if last is None or t.timestamp() - last >= min_gap_s:
                last = t.timestamp()
                out.append((k[0], i, t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", ts])

    return events.select(key, "event_id", ts).groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, {ts} timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


class Triggers(StatefulProcessor):
    """For each directory: runs that a change starts, at most one a gap, and a timer for the run that is due when nothing came for long."""

    def __init__(self, key: str, ts: str, min_gap_s: int, fallback_s: int):
        self.key, self.ts, self.gap, self.wait = key, ts, min_gap_s * 1_000_000, fallback_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "accepted long, seen long, event long")

    def due(self, seen: int, event: int) -> tuple[int, str, pd.Timestamp]:
        return event, "fallback", pd.Timestamp((seen + self.wait) * 1000)

    def timer(self, seen: int) -> int:
        return -(-(seen + self.wait) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        accepted_at, seen, event = self.state.get() if self.state.exists() else (None, None, None)
        out: list = []
        if event is None:
            seen = None  # its fallback was said
        before = seen
        new = pd.concat(list(rows)).sort_values([self.ts, "event_id"])  # one micro-batch of a key
        for i, t in zip(new["event_id"].tolist(), new[self.ts], strict=True):
            micros = t.value // 1000
            if seen is not None and micros > seen + self.wait:
                out.append(self.due(seen, event))
            if accepted_at is None or micros - accepted_at >= self.gap:
                accepted_at = micros
                out.append((i, "change", t))
            seen, event = micros, i
        if before is not None:
            self.handle.deleteTimer(self.timer(before))
        self.handle.registerTimer(self.timer(seen))
        self.state.update((accepted_at, seen, event))
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, seen, event = self.state.get()
            if event is not None and self.timer(seen) == expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((self.state.get()[0], seen, None))  # said once: nothing is due until the next event
                yield self.rows(key, [self.due(seen, event)])

    def rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=[self.key, "event_id", "reason", "at"])

    def close(self) -> None:
        pass


def trigger_stream(events: DataFrame, key: str, ts: str, min_gap_s: int = MIN_GAP_S, fallback_s: int = FALLBACK_S, late: str = "0 seconds") -> DataFrame:
    """(key, event_id, reason, at): the runs that a stream of file changes starts, in event time.

    ``change`` rows are the events that ``throttle`` accepts, ``fallback`` rows those of ``needs_fallback`` at the time
    that is due; the state of a directory is three numbers and a timer. It needs the RocksDB state store.
    """
    grouped = events.select(key, "event_id", ts).withWatermark(ts, late).groupBy(key)
    return grouped.transformWithStateInPandas(Triggers(key, ts, min_gap_s, fallback_s), f"{key} long, event_id long, reason string, at timestamp", "Append", "EventTime")


def needs_fallback(events: DataFrame, key: str, ts: str, gap_s: int = FALLBACK_S, write: Write = written) -> DataFrame:
    """Events after which nothing came for the fallback interval: a timed run is due. A key may span many ranges and tasks."""
    rows = ranged(events, key, [ts, "event_id"], write)
    firsts = rows.groupBy("_part", key).agg(F.min(ts).alias("first"))
    near = F.lead(ts).over(Window.partitionBy("_part", key).orderBy(ts, "event_id"))
    both = with_carried(rows.withColumn("_near", near), carried(firsts, key, F.col("first"), "_far", preceding=False), key)
    after, due = F.coalesce("_near", "_far"), F.col(ts) + F.make_interval(secs=F.lit(gap_s))
    return both.withColumn("due", due).where(after.isNull() | (after > F.col("due"))).drop("_part", "_near", "_far")


def overlapping(runs: DataFrame, write: Write = written) -> DataFrame:
    """Runs (run_id, target, started, ended) that begin before an earlier run of their target has ended. A target may span many ranges and tasks."""
    rows = ranged(runs, "target", ["started", "run_id"], write)
    ends = rows.groupBy("_part", "target").agg(F.max("ended").alias("ended"))
    near = F.max("ended").over(Window.partitionBy("_part", "target").orderBy("started", "run_id").rowsBetween(Window.unboundedPreceding, -1))
    both = with_carried(rows.withColumn("_near", near), carried(ends, "target", F.col("ended"), "_far", preceding=True), "target")
    return both.withColumn("busy_until", F.greatest("_near", "_far")).where(F.col("started") < F.col("busy_until")).drop("_part", "_near", "_far")


def latest(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(ts, "event_id")).alias("r")).select("r.*")


def refresh_stream(spark: SparkSession, directory: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> None:
    """Hands all files that came since the last call to ``on_batch``; deletions need a listing (see plans.engine)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(directory)
    files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
