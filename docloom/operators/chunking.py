"""Chunks of texts and tables, in Arrow batches; sampling of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.tables import PIECE_BYTES, Write, bounded, positions, written

MAX_CHARS = 800
OVERLAP = 100
MAX_CHUNKS = 500
#: Separators by rank, and whether a chunk ends before (0) or after (1) them.
TIERS = ((0, ("\n\n", "\n")), (1, ("。", "！", "？", ".", "!", "?", "；", ";")), (0, (" ", "\t")))
SHEET = re.compile(r"^\[sheet: .*\]$")
Chunk = tuple[int, str, int, int]


def end_of_chunk(text: str, lo: int, hi: int) -> int:
    """Where a chunk ends best in (lo, hi): at the last of the first separator that occurs, by rank."""
    for after, separators in TIERS:
        places = ((text.rfind(s, lo, hi), s) for s in separators)
        if (hit := next(((p, s) for p, s in places if p > lo), None)) is not None:
            return hit[0] + after * len(hit[1])
    return hi


def start_of_chunk(text: str, lo: int, hi: int) -> int:
    """Where an overlap starts best in [lo, hi): at the first separator of the highest rank."""
    for _, separators in TIERS:
        if places := [p for s in separators if (p := text.find(s, lo, hi)) >= 0]:
            return min(places)
    return lo


def text_chunks(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[Chunk]:
    """(index, text, start, end) of overlapping chunks that end at paragraphs, sentences or words."""
    n, start, index = len(text), 0, 0
    while start < n:
        limit = min(start + max_chars, n)
        end = limit if limit == n else end_of_chunk(text, start + max_chars // 2, limit)
        body = text[start:end]
        if value := body.strip():
            first = start + len(body) - len(body.lstrip())
            yield index, value, first, first + len(value)
            index += 1
        if end >= n:
            return
        back = end - overlap
        start = max(back, start_of_chunk(text, back, end), start + 1)


def table_chunks(text: str, max_chars: int = MAX_CHARS) -> Iterator[Chunk]:
    """(index, text, start, end) of chunks of whole rows, each under the header of its sheet; offsets are approximate."""
    index = cursor = 0
    header: str | None = None
    rows: list[str] = []
    size = 0

    def flush() -> Iterator[Chunk]:
        nonlocal index, cursor, rows, size
        if rows:
            body = "\n".join(rows)
            yield index, f"{header}\n{body}", cursor, cursor + len(body)
            index, cursor = index + 1, cursor + len(body) + 1
        rows, size = [], len(header or "")

    for line in text.split("\n"):
        if SHEET.match(line.strip()):
            yield from flush()
            header = None
        elif line.strip() and header is None:
            header, size = line, len(line)
        elif line.strip():
            if rows and size + len(line) + 1 > max_chars:
                yield from flush()
            rows.append(line)
            size += len(line) + 1
    yield from flush()


def chunked(docs: DataFrame, split: Callable[[str], Iterator[Chunk]], key: str) -> DataFrame:
    def batch(ids: list[int | None], found: list[Chunk]) -> pa.RecordBatch:
        index, text, start, end = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "chunk_index", "text", "start_offset", "end_offset"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of PIECE_BYTES characters at a time, however many a text or a batch of texts has."""
        ids, found, size = [], [], 0
        for b in it:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                for c in split(t.as_py() or ""):
                    ids.append(i.as_py())
                    found.append(c)
                    size += len(c[1])
                    if size >= PIECE_BYTES:
                        yield batch(ids, found)
                        ids, found, size = [], [], 0
        if found:
            yield batch(ids, found)

    return bounded(docs).select(F.col(key).cast("long").alias("id"), F.col("text")).mapInArrow(batches, "id long, chunk_index int, text string, start_offset int, end_offset int").withColumnRenamed("id", key)


def chunk_text(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, text, start_offset, end_offset) of docs (key, text)."""
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and overlap at least zero and below it")
    return chunked(docs, lambda t: text_chunks(t, max_chars, overlap), key)


def chunk_tabular(docs: DataFrame, max_chars: int = MAX_CHARS, key: str = "doc_id") -> DataFrame:
    return chunked(docs, lambda t: table_chunks(t, max_chars), key)


def sample_evenly(rows: DataFrame, group: str, order: str, most: int = MAX_CHUNKS, write: Write = written) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced in the order, which keep their numbers.

    Groups within the bound pass as they are; only the rows of larger groups are numbered, in ranges, so that a group of
    any size is spread over many tasks. Of n rows, those at floor(i * n / most) stay: where a multiple of n / most lies in [at, at + 1).
    """
    if most <= 0:
        return rows
    large = write(rows.groupBy(F.col(group).alias("_large")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_large"))
    in_large = F.col(group).eqNullSafe(F.col("_large"))
    placed = positions(rows.join(large, in_large, "left_semi"), [order], [group], write)
    # integers: the least i with i * n >= at * most is below the least i with i * n >= (at + 1) * most
    taken = F.expr(f"(at * {most} + group_size - 1) div group_size < ((at + 1) * {most} + group_size - 1) div group_size")
    return rows.join(large, in_large, "left_anti").unionByName(placed.where(taken).select(rows.columns))
