"""URL rules by a sort-merge range join with a sweep.

A host is keyed by its labels in reverse, each followed by a dot (``com.example.``); the host of a rule then becomes
the interval of all keys with that prefix, and intervals are nested or apart. URLs and rules are range-partitioned by key
(and id, so that a frequent host is spread) and the partitions are written down. A partition also gets the rules that are
open where it begins, by an equality join on its first key and the domains above it. Each partition is read in key order
with a stack of the rules whose intervals are open: a URL is judged by those of the stack whose path its own path starts
with, found by one lookup for each length of path, and the longest rule wins.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; no fitting rule is ``allow``;
of equal rules with different verdicts ``block`` wins; repeated rows are judged alike and stay; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint

#: Rows of a partition, and the most partitions; their bounds are broadcast.
PARTITION_ROWS = 50_000
MAX_PARTITIONS = 4_096
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def prefixes(key: Column) -> Column:
    """The keys of a host and of all domains above it."""
    labels = F.split(key, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))


class Stack:
    """The rules whose intervals are open, by host, the widest first."""

    def __init__(self):
        self.levels: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        """Leaves the intervals that do not hold the key."""
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, {}, []))
        _, rules, lengths = self.levels[-1]
        if path not in rules or verdict == "block":  # of equal rules block wins
            rules[path] = rule, verdict
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def best(self, path: str) -> tuple[str | None, str]:
        """The longest rule whose path the path starts with: one lookup for each length of a level."""
        found: tuple[str | None, str] = None, DEFAULT
        for _, rules, lengths in self.levels:
            for n in lengths:
                hit = rules.get(path[:n]) if n <= len(path) else None
                if hit is not None:
                    if found[0] is None or (len(hit[0]), hit[0]) > (len(found[0]), found[0]):
                        found = hit
                    break
        return found


def judge(pages: DataFrame, rules: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for pages (page_id, url) and rules (host, path, verdict), a row for each row of pages."""
    none = F.lit(None).cast("string")
    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("page_id").cast("long").alias("page_id"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", none.alias("verdict"))
    host = F.translate("host", UPPER, LOWER)
    keyed = rules.select(host_key(host).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.concat("host", "path").alias("host"), "path", "verdict").where("key <> ''").distinct()
    parts = min(MAX_PARTITIONS, max(2, -(-pages.count() // partition_rows)))
    dealt = checkpoint(urls.unionByName(keyed).repartitionByRange(parts, "key", "kind", "page_id").withColumn("part", F.spark_partition_id()))
    # rules that are open where a partition begins are those of its first key and of the domains above it
    begins = dealt.groupBy("part").agg(F.min("key").alias("lo")).select("part", F.explode(prefixes(F.col("lo"))).alias("key"))
    sent = begins.join(keyed, "key").select(dealt.columns)

    def sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = Stack(), None
        for b in it:
            ids, hosts, paths, found = [], [], [], []
            for key, kind, page_id, host, path, verdict, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at:
                    at, stack = part, Stack()
                stack.close(key)
                if kind == 0:
                    stack.open(key, path, host, verdict)
                    continue
                ids.append(page_id)
                hosts.append(host)
                paths.append(path)
                found.append(stack.best(path))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    both = dealt.unionByName(sent).repartition("part").sortWithinPartitions("part", "key", "kind")
    return both.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
