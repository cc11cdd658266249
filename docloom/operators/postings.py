"""An index of trigrams for text search: postings in segments, joined by a query's rarest trigrams, and statistics kept by deltas.

A posting is one trigram of one chunk, with the places where it stands and the chunk's size. A run adds a segment with the postings
of what it extracted anew; nothing is rewritten. ``versions`` says which version of a document counts, so older postings are dead
without being touched, until a run merges the segments. ``text_statistics`` holds the number of chunks and their sizes, to which each
run adds what it wrote and from which it takes what it replaced.

Within a segment, postings are dealt to buckets by a hash of their trigram (as many as its size asks for) and sorted by it, so a query
opens the buckets of its trigrams only. A frequent trigram is split among files. A phrase is found where its trigrams stand at their
distances; a third of them, and the last, cover it. No text is read.

A corpus that is indexed at once need not be dealt to buckets: its postings are packed and stay where its texts are read, sorted by
trigram in each file, and a query opens the pages of its trigrams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.operators.tables import Write, bounded, pieces, written

SCHEMA = "buckets int, bucket int, trigram string, document_id long, chunk_index int, version long, size int, positions array<int>"
#: The same for a corpus that is indexed at once: all chunks of a piece of texts that hold a trigram in one row, their numbers as gaps in bytes of seven bits.
PACKED = "trigram string, version long, n int, documents binary, chunks binary, sizes binary, counts binary, positions binary"
#: How packed rows are written: a query skips the pages between its trigrams, so pages are small.
PAGES = {"compression": "zstd", "parquet.page.row.count.limit": "2048"}
#: Code points for each of which a bucket is made, in powers of BASE, and the most powers.
BUCKET_SIZE, BASE, MOST_POWERS = 32_000_000, 4, 8
#: Segments that are merged into one by the run that finds so many.
MOST_SEGMENTS = 16
BITS = 21  # of a code point


def occurrences(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lowered texts (the third column): different trigrams in order, of each pair of trigram and text the trigram, the row and where its places begin, and all places."""
    texts = [np.frombuffer(x.as_py().encode("utf-32-le"), np.uint32) for x in b.column(2)]
    lengths = np.array([len(x) for x in texts], np.int64)
    points = np.concatenate([*texts, np.zeros(2, np.uint32)]).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < np.repeat(lengths, lengths) - 2
    keys = (points[:-2] << np.uint64(2 * BITS) | points[1:-1] << np.uint64(BITS) | points[2:])[inside]
    row, at = row[inside], at[inside]
    order = np.argsort(keys, kind="stable")  # rows and places ascend already
    keys, row, at = keys[order], row[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    values, which = np.unique(keys[starts], return_inverse=True)
    names = pa.array(["".join(chr(int(v) >> s & (1 << BITS) - 1) for s in (2 * BITS, BITS, 0)) for v in values], pa.string())
    return names, which, row[starts], starts, at


def lowered(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_index, lowered, size) of chunks (document_id, chunk_index, text) that have a text."""
    rows = chunks.select(F.col("document_id").cast("long"), F.col("chunk_index").cast("int"), F.lower("text").alias("lowered"), search.trigrams(F.col("text")).cast("int").alias("size"))
    return bounded(rows).where(F.col("lowered").isNotNull())


def lists(starts: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))


def post(chunks: DataFrame, version: int, total: int = 0) -> DataFrame:
    """SCHEMA rows of chunks (document_id, chunk_index, text), whose sizes add up to about ``total``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in it for p in pieces(whole, 2)):
            names, which, row, starts, at = occurrences(b)
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), b.column(0).take(owner), b.column(1).take(owner), b.column(3).take(owner), lists(starts, at)], ["trigram", "document_id", "chunk_index", "size", "positions"])

    found = lowered(chunks).mapInArrow(batches, "trigram string, document_id long, chunk_index int, size int, positions array<int>")
    buckets = BASE ** powers(total)
    return found.withColumns({"version": F.lit(version).cast("long"), "buckets": F.lit(buckets), "bucket": bucket(F.col("trigram"), buckets)})


def packed(chunks: DataFrame, version: int) -> DataFrame:
    """PACKED rows of chunks (document_id, chunk_index, text): a row for each trigram of a piece of texts. They stay in the task that reads the texts, sorted by trigram."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in it for p in pieces(whole, 2)):
            names, which, row, starts, at = occurrences(b)
            if not len(at):
                continue
            first = np.flatnonzero(np.diff(which, prepend=-1))
            own = lambda k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[row]  # noqa: B023, E731
            signed = lambda k: varints(zigzag(gaps(own(k), first)), first)  # noqa: B023, E731
            counts, n = np.diff(np.append(starts, len(at))), np.diff(np.append(first, len(row)))
            yield pa.RecordBatch.from_arrays([names, pa.array(n.astype(np.int32)), signed(0), signed(1), varints(own(3), first), varints(counts, first), varints(gaps(at, starts), starts[first])], ["trigram", "n", "documents", "chunks", "sizes", "counts", "positions"])

    rows = lowered(chunks).where(F.col("document_id").isNotNull() & F.col("chunk_index").isNotNull())  # else no version counts, and nothing is found
    return rows.mapInArrow(batches, "trigram string, n int, documents binary, chunks binary, sizes binary, counts binary, positions binary").withColumn("version", F.lit(version).cast("long")).sortWithinPartitions("trigram")


def unpacked(rows: DataFrame) -> DataFrame:
    """PACKED rows as those of SCHEMA, without buckets; others as they are."""
    if "n" not in rows.columns:
        return rows

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in it for p in pieces(whole, 7)):
            n = b.column(2).to_numpy().astype(np.int64)
            counts = numbers(b.column(6))
            first, starts = np.cumsum(n) - n, np.cumsum(counts) - counts
            signed = lambda k: summed(unzigzag(numbers(b.column(k))), first, n)  # noqa: B023, E731
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            at = summed(numbers(b.column(7)), starts, counts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), pa.array(signed(3)), pa.array(signed(4).astype(np.int32)), b.column(1).take(owner), pa.array(numbers(b.column(5)).astype(np.int32)), lists(starts, at)], ["trigram", "document_id", "chunk_index", "version", "size", "positions"])

    return bounded(rows).select("trigram", "version", "n", "documents", "chunks", "sizes", "counts", "positions").mapInArrow(batches, "trigram string, document_id long, chunk_index int, version long, size int, positions array<int>")


def gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each number is above the one before it; the first of a group stays."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def summed(gaps: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of groups that begin at ``first``, of their gaps."""
    total = np.cumsum(gaps)
    return total - np.repeat(total[first] - gaps[first], lengths)


def zigzag(values: np.ndarray) -> np.ndarray:
    return values << 1 ^ values >> 63


def unzigzag(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(values & 1)


def varints(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary for each group of numbers that begins at ``first``: seven bits a byte, the last byte of a number below 128."""
    left, n = values.astype(np.int64).view(np.uint64), np.ones(len(values), np.int64)
    for k in range(1, 10):
        n += left >= np.uint64(1 << 7 * k)
    ends = np.cumsum(n)
    out, begin = np.empty(ends[-1], np.uint8), ends - n
    for k in range(n.max()):
        m = np.flatnonzero(n > k)
        out[begin[m] + k] = (left[m] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (n[m] > k + 1).astype(np.uint8) << 7
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(begin[first], ends[-1]).astype(np.int32)), pa.py_buffer(out)])


def numbers(column: pa.Array) -> np.ndarray:
    """All numbers of a column of varints."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    begin = np.append(0, ends)[:-1]
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - begin).max(initial=0))):
        m = np.flatnonzero(ends - begin > k)
        out[m] |= (raw[begin[m] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)


def powers(total: int) -> int:
    """The power of BASE that is the number of buckets for texts of such a size."""
    return min(MOST_POWERS, max(0, math.ceil(math.log(max(total, 1) / BUCKET_SIZE, BASE))))


def bucket(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(buckets)).cast("int")


def laid_out(rows: DataFrame) -> DataFrame:
    """Postings as a segment has them: buckets together, large ones split, sorted by trigram."""
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram")


def of(postings: DataFrame, grams: list[str]) -> DataFrame:
    """The postings of some trigrams, by their buckets; packed ones have none, and lie sorted in their files."""
    if "buckets" not in postings.columns:
        return postings.where(F.col("trigram").isin(grams))
    sizes = [BASE**k for k in range(MOST_POWERS + 1)]
    names = postings.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g"))
    rows = names.select(*[bucket(F.col("g"), n).alias(str(n)) for n in sizes]).collect()  # a row for each trigram of the query
    opened = reduce(lambda a, b: a | b, [(F.col("buckets") == n) & F.col("bucket").isin(sorted({r[str(n)] for r in rows})) for n in sizes])
    return postings.where(opened & F.col("trigram").isin(grams))


def cover(phrase: str) -> list[tuple[int, str]]:
    """(place, trigram) of trigrams that cover a phrase of three characters or more."""
    last = len(phrase) - 3
    return [(i, phrase[i : i + 3]) for i in sorted({*range(0, last + 1, 3), last})]


CHUNK = ["document_id", "chunk_index", "version"]


def phrase_places(postings: DataFrame, phrase: str, counts: dict[str, int]) -> DataFrame | None:
    """(document_id, chunk_index, version, size, f): the chunks that hold a phrase, and how often; None if a trigram is missing.

    The rarest trigram comes first; each further one can only leave fewer chunks.
    """
    grams = sorted(cover(phrase), key=lambda g: (counts.get(g[1], 0), g))
    if not all(counts.get(g) for _, g in grams):
        return None
    begin = lambda at: F.transform("positions", lambda x: x - at)
    rows = None
    for at, g in grams:
        own = unpacked(postings.where(F.col("trigram") == g)).select(*CHUNK, "size", begin(at).alias("p"))
        if rows is not None:
            own = rows.join(own.select(*CHUNK, F.col("p").alias("q")), CHUNK).select(*CHUNK, "size", F.array_intersect("p", "q").alias("p")).where(F.size("p") > 0)
        rows = own
    return rows.select(*CHUNK, "size", F.size("p").cast("double").alias("f"))


def bm25(postings: DataFrame, versions: DataFrame, n: int, size: int, query: search.Phrases, write: Write = written) -> tuple[DataFrame, int]:
    """(doc_id, chunk_index, bm25) of the chunks that a query finds, and at most how many they are; as ``search.bm25`` over all texts.

    versions (document_id, version) are those that count; n and size are the statistics of all chunks that count.
    """
    every = query.named
    read = of(postings, sorted({g for p in every for _, g in cover(p)}))
    counts = {r["trigram"]: r["n"] for r in read.groupBy("trigram").agg((F.sum("n") if "n" in read.columns else F.count(F.lit(1))).alias("n")).collect()}  # a row for each trigram of the query
    parts = [x.withColumn("phrase", F.lit(i)) for i, x in ((i, phrase_places(read, p, counts)) for i, p in enumerate(every)) if x is not None]
    if not parts:
        return unpacked(postings).select(F.col("document_id").alias("doc_id"), "chunk_index", F.lit(0.0).alias("bm25")).where("false"), 0
    each = reduce(DataFrame.unionByName, parts).groupBy(*CHUNK).agg(F.max("size").alias("size"), *[F.max(F.when(F.col("phrase") == i, F.col("f"))).alias(f"f{i}") for i in range(len(every))])
    seen = Observation()
    hits = write(each.join(versions, ["document_id", "version"], "left_semi").observe(seen, F.count(F.lit(1)).alias("n"), *[F.count(f"f{i}").alias(f"p{i}") for i in range(len(every))]))
    stats, at = seen.get, [every.index(p) for p in query.all]
    value = search.score([F.coalesce(f"f{i}", F.lit(0.0)) for i in at], F.col("size"), n, size / max(n, 1), [stats[f"p{i}"] for i in at])
    found = hits.where(search.matches(query, lambda p: F.col(f"f{every.index(p)}").isNotNull()))
    return found.select(F.col("document_id").alias("doc_id"), "chunk_index", value.alias("bm25")), stats["n"]


def statistics(chunks: DataFrame) -> tuple[int, int]:
    """Number and size of chunks (text)."""
    r = chunks.where(F.col("text").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(search.trigrams(F.col("text"))), F.lit(0)).alias("size")).first()
    return r["n"], r["size"]
