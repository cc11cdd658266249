"""Exact duplicates, which one to keep, and plans for clean-up and undo; nothing is ever deleted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def same_size(files: DataFrame) -> DataFrame:
    """The rows whose size another row has; only their contents need reading."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def hashed(files: DataFrame, content: str = "content") -> DataFrame:
    """files (path, size, content, ...) of a shared size, with ``sha256`` instead of the content."""
    return same_size(files).withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).drop(content)


def groups(files: DataFrame) -> DataFrame:
    """(sha256, paths, size, n, wasted) of contents that several of the hashed files have; members stay apart in ``members``."""
    g = files.groupBy("sha256").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").withColumn("wasted", F.col("size") * (F.col("n") - 1))


def members(files: DataFrame) -> DataFrame:
    """(sha256, path, size, mtime, keep): one row a file; the oldest is kept, then the shortest path, then the first.

    The keeper is found by a minimum, so that a group of any size is never gathered.
    """
    age = F.coalesce(F.col("mtime").cast("double"), F.lit(float("inf")))
    best = files.groupBy("sha256").agg(F.min(F.struct(age.alias("age"), F.length("path").alias("len"), "path")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha256", F.col("b.path").alias("keeper"))
    return files.join(best, "sha256").select("sha256", "path", "size", "mtime", (F.col("path") == F.col("keeper")).alias("keep"), "keeper")


def cleanup_plan(files: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(sha256, kept_path, deleted_path, size_bytes): what a clean-up would remove; decisions (sha256, action) may skip groups."""
    rows = members(files).where("not keep").select("sha256", F.col("keeper").alias("kept_path"), F.col("path").alias("deleted_path"), F.col("size").alias("size_bytes"))
    return rows if decisions is None else rows.join(decisions.where("action = 'keep'").select("sha256"), "sha256", "left_semi")


def undo_plan(log: DataFrame, trash: DataFrame, existing: DataFrame) -> DataFrame:
    """(sha256, trash_path, restore_to, status) for a log of removals and restorations, the files in the trash (path, size, sha256), and the paths that exist."""
    removed = log.where("restored_path is null and deleted_path is not null").select("sha256", "deleted_path", "size_bytes").distinct()
    back = log.where("restored_path is not null").select("sha256", F.col("restored_path").alias("deleted_path"))
    open_ = removed.join(back, ["sha256", "deleted_path"], "left_anti")
    found = trash.groupBy("sha256", F.col("size").alias("size_bytes")).agg(F.min("path").alias("trash_path"))
    taken = existing.select(F.col("path").alias("deleted_path"), F.lit(True).alias("taken")).distinct()
    rows = open_.join(found, ["sha256", "size_bytes"], "left").join(taken, "deleted_path", "left")
    status = F.when(F.col("trash_path").isNull(), "missing").when(F.col("taken"), "occupied").otherwise("restore")
    return rows.select("sha256", "trash_path", F.col("deleted_path").alias("restore_to"), status.alias("status"))


LOG = "timestamp string, sha256 string, kept_path string, deleted_path string, size_bytes long, restored_path string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The clean-up log, JSON lines of removals and restorations; lines that are blank or no JSON are passed over."""
    return spark.read.schema(LOG).option("mode", "PERMISSIVE").json(path).where("sha256 is not null")


def append_log(entries: DataFrame, path: str) -> None:
    """Adds removals or restorations to the log."""
    entries.select(*[name for name, _ in (x.split() for x in LOG.split(", "))]).write.mode("append").json(path)


def trash_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, size, sha256) of all files in trash folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def report_lines(members: DataFrame) -> DataFrame:
    """(sha256, keep, path, line): a report of groups as Markdown, one line a file, the keeper first."""
    mark = F.when(F.col("keep"), "keep").otherwise("duplicate")
    return members.select("sha256", "keep", "path", F.concat(F.lit("- "), mark, F.lit(": "), F.col("path"), F.format_string(" (%d bytes)", "size")).alias("line")).orderBy("sha256", F.col("keep").desc(), "path")
