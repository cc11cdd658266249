"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Every filter is evaluated once for each document; bit i of ``failed`` says that filter i of ``FILTERS`` removes it. Orders are
never applied to documents: documents are added up by part, mask and label, and each of the 120 orders is worked out from the
counters of the 32 masks, which are additive.

The fifth filter, duplicates, is found by sorting. Texts are dealt to ranges of (fingerprint, doc_id) and each range is sorted by
fingerprint, full text and doc_id, so that a document repeats a smaller one if the text before it is the same. A group of copies of
any size is cut into ranges by doc_id and never gathered. At the borders: only the first document of a run at the head of a range
can repeat a text of an earlier range; such heads, and the last runs of all ranges, go to a table of a few rows a range, whose join
decides them. Texts are compared in full there too.

Cases: a null text is empty, a null lang is the part ''; an empty text has no words and passes B and C; documents without a doc_id
repeat nothing and are repeated by nothing; rows of equal doc_id and text repeat no smaller one (both stand); labels without a document
are passed over, and of several labels of a document any that says so counts; an empty table gives no rows; other columns are never
read. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, text_bytes, written

FILTERS = "ABCDE"
#: Fixed value: the symbols of filter D.
SYMBOLS = b"#$%&*|"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
DUPLICATE = 1 << FILTERS.index("E")
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
CONTINUATION = bytes(range(0x80, 0xC0))
#: The place of documents without a doc_id: after all others.
NO_ID = (1 << 63) - 1


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at ASCII white space
    few_words = len(words) < MIN_WORDS
    repetitive = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    shouting = 100 * len(text.translate(None, NOT_UPPER)) > MAX_UPPER_PERCENT * len(text.translate(None, CONTINUATION))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return few_words | repetitive << 1 | shouting << 2 | symbols << 3


#: kind: a decided document, the first document of a run at the head of a range, or the last run of a range (text and doc_id only).
DECIDED, HEAD, LAST = 0, 1, 2
SORTED = "kind int, doc_id long, part string, failed int, fingerprint long, text binary"


def sorted_failures(docs: DataFrame) -> DataFrame:
    """SORTED rows: every document with its failures, the duplicates of decided ones included, and the borders of all ranges."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # the first fingerprint of the range, and the one that was read last
        runs: dict[bytes, int] = {}  # texts of the last fingerprint: the least doc_id of each
        for b in it:
            prints, ids, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            same = np.zeros(b.num_rows, bool)
            same[1:] = (prints[1:] == prints[:-1]) & pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(~same)
            least = ids[starts]
            first = int(prints[0]) if first is None else first
            at = texts[0].as_py()
            if int(prints[0]) == last and at in runs:
                least[0] = runs[at]
            lows = np.repeat(least, np.diff(np.append(starts, b.num_rows)))
            for k in starts[prints[starts] == prints[-1]].tolist():
                if int(prints[k]) != last:
                    last, runs = int(prints[k]), {}
                runs.setdefault(texts[k].as_py(), int(lows[k]))
            again = (ids > lows) & (ids != NO_ID)
            failed = np.fromiter((text_failures(t.as_py()) for t in texts), np.int32, b.num_rows) | np.where(again, DUPLICATE, 0).astype(np.int32)
            head = (prints == first) & ~again & (ids != NO_ID)
            border = pc.if_else(pa.array(head), texts, pa.scalar(None, texts.type))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(head, HEAD, DECIDED).astype(np.int32)), pa.array(ids, mask=ids == NO_ID), b.column(3), pa.array(failed), pa.array(prints), border.cast(pa.binary())], names)
        if runs:
            n = len(runs)
            yield pa.RecordBatch.from_arrays([pa.array([LAST] * n, pa.int32()), pa.array(list(runs.values()), pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([last] * n, pa.int64()), pa.array(list(runs), pa.binary())], names)

    names = [x.split()[0] for x in SORTED.split(", ")]
    rows = bounded(docs).select(text_bytes().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.select(F.xxhash64("text").alias("fingerprint"), "doc_id", "text", "part")
    return rows.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id").mapInArrow(batches, SORTED)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed): the mask of each document, all five filters decided."""
    rows = written(sorted_failures(docs))
    before = rows.where(F.col("kind") == LAST).groupBy("fingerprint", "text").agg(F.min("doc_id").alias("least"))
    heads = rows.where(F.col("kind") == HEAD).join(before, ["fingerprint", "text"], "left")
    decided = heads.withColumn("failed", F.when(F.col("least") < F.col("doc_id"), F.col("failed").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("failed")))
    return rows.where(F.col("kind") == DECIDED).select("doc_id", "part", "failed").unionByName(decided.select("doc_id", "part", "failed"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents, and those of them with such labels, of each part and mask."""
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = masks.join(says, "doc_id", "left")
    return rows.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def interactions(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the counters alone.

    The documents of a mask of k bits are removed by each of their filters in 120 / k of the orders, which gives ``shapley``.
    """
    bit_at = lambda at: F.expr(f"shiftleft(1, ascii(substring(filter_order, {at}, 1)) - {ord(FILTERS[0])})")
    earlier = sum((F.when(F.col("step") > at, bit_at(at)).otherwise(0) for at in range(1, len(FILTERS))), F.lit(0))
    every = counted.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders())), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = every.withColumns({"bit": bit_at("step"), "earlier": earlier})
    has = lambda mask: F.col("failed").bitwiseAND(F.col(mask)) != 0
    total = lambda condition, value="n": F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))
    removed, orders_each = has("bit") & ~has("earlier"), F.lit(len(orders())) / F.bit_count("failed")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~has("bit") & ~has("earlier")).alias("kept"),
        total(removed).alias("removed"),
        total(has("bit") & has("earlier")).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(has("bit"), F.col("n") * orders_each.cast("long"))), F.lit(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over docs."""
    return interactions(counters(failures(docs), labels))
