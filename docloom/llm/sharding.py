"""Shards of a corpus along a Hilbert curve, in DataFrame operations only.

Several metadata dimensions are quantised to ``BITS`` bits each and give a cell on the curve; rows are sorted by curve
index and cut into shards whose numbers of rows differ by one at most (the law ``rows``). Shards are then compact in
all the dimensions at once, so that a filter on any of them prunes files. Rows of one cell are ordered by the text's
checksum, so that equal texts stand together, then by id: any share of all rows may fall into one cell, or be one
text, without a task having more rows than others.

Places in the order come from a range partitioning that is written down, the number of rows of each partition, and
each row's place in its partition.

Cases: null metadata are cell zero of their dimension; a null text has no bytes; repeated rows get slots of their own;
fewer rows than shards leave shards empty; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, text_bytes

BITS = 5
SHARDS = 40
ROW_OVERHEAD = 16
#: Rows of a partition of the sort.
PARTITION_ROWS = 50_000


def hilbert_index(x: list[Column], bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve of len(x) dimensions: axes are transposed bit by bit, folded over the bits."""
    n = len(x)
    names = [f"x{i}" for i in range(n)]
    start = F.struct(*[c.cast("int").alias(name) for c, name in zip(x, names, strict=True)])

    def turn(state: Column, q: Column) -> Column:
        p = q - 1
        v = [state[name] for name in names]
        for i in range(n):
            on = v[i].bitwiseAND(q) != 0
            t = v[0].bitwiseXOR(v[i]).bitwiseAND(p)
            first = F.when(on, v[0].bitwiseXOR(p)).otherwise(v[0].bitwiseXOR(t))
            if i:
                v[i] = F.when(on, v[i]).otherwise(v[i].bitwiseXOR(t))
            v[0] = first
        return F.struct(*[c.alias(name) for c, name in zip(v, names, strict=True)])

    def gray(state: Column) -> Column:
        v = [state[name] for name in names]
        for i in range(1, n):
            v[i] = v[i].bitwiseXOR(v[i - 1])
        t = F.lit(0)
        for k in range(bits - 1, 0, -1):
            t = F.when(v[-1].bitwiseAND(F.lit(1 << k)) != 0, t.bitwiseXOR(F.lit((1 << k) - 1))).otherwise(t)
        v = [c.bitwiseXOR(t) for c in v]
        out = F.lit(0).cast("long")
        for k in range(bits - 1, -1, -1):
            for c in v:
                out = out * 2 + F.shiftright(c, k).bitwiseAND(F.lit(1))
        return out

    steps = F.array(*[F.lit(1 << k) for k in range(bits - 1, 0, -1)])
    return F.aggregate(steps, start, turn, gray)


def quantised(value: Column, bits: int = BITS) -> Column:
    """A cell of a categorical dimension."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.crc32(value.cast("binary")), F.lit(1 << bits))).cast("int")


def magnitude(value: Column, bits: int = BITS) -> Column:
    """A cell of a numeric dimension, by its logarithm."""
    return F.least(F.greatest(F.floor(2 * F.log2(F.coalesce(value, F.lit(0)) + 1)) - 8, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def ordered(rows: DataFrame, keys: list[str], partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """rows with ``place``, from 0 without gaps in the order of keys."""
    parts = max(2, -(-rows.count() // partition_rows))
    dealt = checkpoint(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return dealt.withColumn("place", own.cast("long")).join(F.broadcast(before), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def shard_by_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert), a row for each row of docs."""
    text = text_bytes()
    cell = hilbert_index([quantised(F.col("lang")), quantised(F.col("source")), magnitude(F.length(text))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("hilbert"))
    placed = checkpoint(ordered(rows, ["hilbert", "text_crc32", "size", "doc_id"]))
    n = placed.count()
    small, more = divmod(n, shards)  # the first ``more`` shards have a row more
    edge = more * (small + 1)
    shard = F.when(F.col("place") < edge, F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - edge) / max(1, small)))
    first = F.col("shard") * small + F.least(F.col("shard"), F.lit(more))
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
