"""Intermediate results that are written once, and numbers of rows that no single task hands out."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Writes rows where all executors see them, and returns them read anew.
Write = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on one machine, where it is unset, one of this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return sc.getCheckpointDir()


def written(rows: DataFrame, **options: str) -> DataFrame:
    """rows as a Parquet table of the shared folder: computed once, and read back after the loss of an executor."""
    path = f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Bytes of an Arrow batch, where the session does not say otherwise; Spark's own bound by rows lets long texts grow a batch without end.
BATCH_BYTES = "8m"
#: Bytes of texts that a Python task works on at a time, and characters that it gives back at a time.
PIECE_BYTES = 1 << 20


def bounded(rows: DataFrame) -> DataFrame:
    """rows, in a session that bounds the bytes that go to Python at a time (a longer row is a batch of its own)."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return rows


def pieces(b: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of a text or binary column; a longer row is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < b.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield b.slice(first, last - first)
        first = last


#: Bits of a generated row number that count within its partition; the others are the partition.
WITHIN = 33


def ranged(rows: DataFrame, group: str, order: list[str], write: Write = written) -> DataFrame:
    """rows with ``_part``, the range of (group, order) that each lies in: a window over (_part, group) never sees more than a range."""
    return write(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()))


def carried(parts: DataFrame, group: str, value: Column, name: str, preceding: bool) -> DataFrame:
    """(_part, group, name): what the ranges before (or after) each one carry into it, of parts with a row for each group and range."""
    beside = Window.partitionBy(group).orderBy("_part")
    frame = beside.rowsBetween(Window.unboundedPreceding, -1) if preceding else beside.rowsBetween(1, 1)
    return parts.select("_part", F.col(group).alias("_group"), (F.max(value) if preceding else F.first(value)).over(frame).alias(name))


def with_carried(rows: DataFrame, other: DataFrame, group: str) -> DataFrame:
    return rows.join(other.withColumnRenamed("_part", "_other"), (F.col("_part") == F.col("_other")) & F.col(group).eqNullSafe(F.col("_group")), "left").drop("_other", "_group")


def positions(rows: DataFrame, order: list[str], group: list[str] | None = None, write: Write = written) -> DataFrame:
    """rows with ``at``, from 0 in the order of columns within each group (of all rows, without a group), and ``group_size``.

    Rows are dealt to ranges of (group, order), sorted and numbered where they lie. The counts of ranges, at most a row
    for each group and one for each range, make the offsets; so a group of any size spans many tasks, and no window
    sees its rows. Rows that are equal in group and order have some order among themselves.
    """
    keys = group or []
    lying = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_number", F.monotonically_increasing_id())
    lying = write(lying).withColumns({"_part": F.shiftright("_number", WITHIN), "_within": F.col("_number").bitwiseAND(F.lit((1 << WITHIN) - 1))})
    counts = lying.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_within").alias("_first"))
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first"), "group_size": F.sum("_n").over(whole)}).drop("_n", "_first")
    same = F.lit(True)
    for k in [*keys, "_part"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}"))
    both = lying.alias("l").join(counts.alias("c"), same)
    return both.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_before") + F.col("_within")).alias("at"), "group_size")


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0, write: Write = written) -> DataFrame:
    """rows with ``name``: dense numbers after ``start`` in the order of columns."""
    return positions(rows, order, write=write).withColumn(name, F.col("at") + F.lit(start + 1)).drop("at", "group_size")
