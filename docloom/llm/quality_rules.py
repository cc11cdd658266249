"""Quality rules as a ledger of failure bits.

``measure`` reads each text once and stores its measurements; ``ledger`` evaluates every rule of ``RULES`` once and
stores bit i of ``failed`` for rule i. A policy is a named, versioned mask of rules: ``apply_policy`` is a bitwise
and, and ``ablations`` counts, from the masks alone (grouped, so that only the few distinct masks are moved), what
each rule of a policy rejects and what only that rule rejects.

Cases: a null or empty text has zero everywhere and fails ``few_words``; a repeated row stays a row of its own;
an empty table gives an empty ledger; other columns are never read. Texts are processed whole; two windows of words
count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BASE, IS_SPACE, bounded, per_row, slices, splitmix, text_buffer, text_bytes, window_hashes, word_table

WINDOW = 5
#: Fixed value: the symbols that are counted.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
IS_UPPER, IS_LOWER = np.zeros(256, bool), np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LOWER[97:123] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")

#: name, SQL condition over the measurements; the place in the list is the bit. Append only: stored masks keep their meaning.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "2 * n_upper > n_upper + n_lower"),
    ("long_words", "word_chars > 40 * n_words"),
)
#: name, version: the rules that reject.
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("web", 1): ("few_words", "repeated_words", "symbols", "repeated_lines", "shouting"),
    ("strict", 1): tuple(name for name, _ in RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text."""
    at = offsets - offsets[0]
    text = data[offsets[0] : offsets[-1]]
    n = len(at) - 1
    row, _, _, h = word_table(data, offsets)
    first, keys = window_hashes(row, h, WINDOW)
    keys = splitmix(keys + row[first].astype(np.uint64) * np.uint64(BASE))  # windows of other texts are other keys
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + WINDOW, -1)
    lines = np.array([line_counts(text[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
    return np.stack(
        (
            np.bincount(row, minlength=n),
            per_row(~IS_SPACE[text] & (text & 0xC0 != 0x80), at),
            per_row(IS_SYMBOL[text], at),
            lines[:, 0],
            lines[:, 1],
            np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n),
            per_row(IS_UPPER[text], at),
            per_row(IS_LOWER[text], at),
        )
    )


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, *MEASURES), a row for each row of docs."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offsets = text_buffer(b.column(1))
            for a, e in slices(offsets):
                got = measures(data, offsets[a : e + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), *map(pa.array, got)], ["doc_id", *MEASURES])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements with ``failed``: bit i is set if rule i fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    failed: Column = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def apply_policy(failed: Column, policy: tuple[str, int]) -> Column:
    """Whether a row passes a policy."""
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """For each rule of a policy: (rule, rejected, rejected_alone, kept_without) over a ledger."""
    whole = mask(POLICIES[policy])
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = masks.select("n", F.col("failed").bitwiseAND(F.lit(whole)).alias("failed"), F.explode(rules).alias("r")).select("n", "failed", "r.rule", "r.bit")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    none_else = F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("rejected"), total(hit & none_else).alias("rejected_alone"), total(none_else).alias("kept_without"))


def judge(docs: DataFrame, policy: tuple[str, int] = ("web", 1)) -> DataFrame:
    """The ledger of docs with the verdicts of the base policy and of ``policy``."""
    rows = ledger(measure(docs))
    return rows.withColumns({"base_failed": ~apply_policy(F.col("failed"), ("base", 1)), "kept": apply_policy(F.col("failed"), policy) & apply_policy(F.col("failed"), ("base", 1))})
