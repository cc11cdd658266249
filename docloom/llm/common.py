"""What the operators of this subpackage share: inputs, checkpoints, connected components.

Inputs are always narrowed to the columns that an operator reads, so further columns of a table,
whatever their names, never meet an operator's own names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.tables import bounded  # noqa: F401  shared with the operators of this subpackage

#: Fixed value: the word of every word-based contract, a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; on one machine (tests), where it is unset, one of this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the checkpoint folder: compressed, and read by columns."""
    spark, path = df.sparkSession, f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``written``, with the rows of a key in one bucket: grouped by it, they are read where they belong and not shuffled."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{checkpoint_folder(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


#: Estimated bytes up to which ``join_few`` broadcasts.
BROADCAST_BYTES = 16 << 20


def join_few(rows: DataFrame, few_: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined to few_, which has one row for each key: broadcast if its measured size allows.

    Beyond that size both sides are shuffled as they are, not as the output of an aggregate, so that adaptive
    execution can split the rows of a hot key.
    """
    return join_written(rows, checkpoint(few_), on, how)


def join_written(rows: DataFrame, few_: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``join_few`` for a side that is already written (a checkpoint or a table)."""
    return rows.join(few(few_), on, how)


def few(written: DataFrame) -> DataFrame:
    """A written side of a join, marked for broadcast if its measured size is within BROADCAST_BYTES."""
    width = F.lit(16)
    for c, kind in written.dtypes:
        width = width + (F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.size(c) * 32 if kind.startswith("array") else F.lit(8))
    size = written.agg(F.sum(width.cast("long")).alias("size")).first()["size"] or 0
    return F.broadcast(written) if size <= BROADCAST_BYTES else written


def splitmix(x: np.ndarray) -> np.ndarray:
    """A well mixed permutation of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roots(label: np.ndarray) -> np.ndarray:
    """Pointer jumping until every entry names its root."""
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of all pairs (a, b); label[i] <= i names a member of i's class, roots name themselves."""
    while len(a):
        label = roots(label)
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
    return roots(label)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the smallest node reachable.

    Alternating large and small stars: each round points neighbours at the smallest node near them, so the
    depth falls geometrically. Minima are aggregated before the shuffle, written and joined back by ``join_few``,
    so that a hub with very many neighbours is never gathered in one task. Every round is checkpointed.
    """
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
        state = tuple(seen)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_few(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = join_written(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


#: Bytes of text that the array kernels take at a time; bounds their memory, of which a byte takes some 150 bytes and the powers below keep 16.
SLICE_BYTES = 1 << 19


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and where each row starts (one entry more than rows)."""
    if not isinstance(column, pa.LargeBinaryArray):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
#: Random 64-bit values of the bytes, and an odd base, for polynomial hashes modulo 2**64.
BYTE_VALUE = splitmix(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal ranges have equal hashes, wherever they are."""
    up, down = powers(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return splitmix((total[ends] - total[starts]) * down[starts])


def word_table(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of each word of rows offsets[i]:offsets[i + 1] of data; start and end are places in data."""
    first, last = int(offsets[0]), int(offsets[-1])
    edges = np.zeros(last - first + 1, bool)
    edges[offsets - first] = True
    parts, at = [], first
    while at < last:
        stop = min(last, at + SLICE_BYTES)
        while stop < last and not edges[stop - first] and not IS_SPACE[data[stop]]:  # to the end of a word
            ahead = min(last, stop + 4096)
            more = np.flatnonzero(IS_SPACE[data[stop:ahead]] | edges[stop - first : ahead - first])
            stop = stop + int(more[0]) if len(more) else ahead
        piece = data[at:stop]
        word = ~IS_SPACE[piece]
        edge = edges[at - first : stop - first]
        starts = word.copy()
        starts[1:] &= ~word[:-1] | edge[1:]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        parts.append((s + at, e + at, range_hashes(BYTE_VALUE[TO_LOWER[piece] if lower else piece], s, e)))
        at = stop
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.searchsorted(offsets, s, "right") - 1, s, e, h


def window_hashes(row: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words that lies in one row."""
    if len(h) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + h[k : k + n]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, splitmix(out[at])


def grouped(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, in tables of one batch or little more; the input is sorted by keys."""
    rest: pa.Table | None = None
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        change = group_starts(t, keys)
        cut = change[-1]
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None:
        yield rest


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
