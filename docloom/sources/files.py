"""File listings: walks without hidden, dependency and project directories; project roots and their summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import basename, parent, under

#: Fixed values.
PROJECT_MARKERS = (".git", "package.json", "pyproject.toml", "setup.py", "requirements.txt", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "oh-package.json5")
DEPENDENCY_DIRS = ("node_modules", "venv", "dist", "build", "oh_modules", "__pycache__", "target", "Pods", "DerivedData")
SUMMARY_FILES = ("README.md", "readme.md", "README.txt", "CLAUDE.md")


#: Paths that are opened by name; more are filtered by time where they are listed.
LISTED = 10_000
LISTING = "path string, size_bytes long, mtime_ns long, content binary"


def read_files(spark: SparkSession, directory: str, since_ns: int | None = None) -> DataFrame:
    """(path, size_bytes, mtime_ns, content) of all files under a directory, or of those changed since a time.

    Contents are read only where the column is used; the time is a filter of the listing.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    if since_ns is not None:
        rows = rows.where(F.col("modificationTime") >= F.timestamp_micros(F.lit(since_ns // 1000)))
    return named(rows)


def named(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def read_listed(spark: SparkSession, directory: str, wanted: DataFrame, most: int = LISTED) -> DataFrame:
    """The same of chosen files (path, mtime_ns) only: nothing is opened if there are none.

    Up to ``most`` files are opened by their names; of more, the listing leaves out what is older than all of them, and the
    join the rest. A file that is gone by then ends the run, and the next one finds it gone.
    """
    paths = [r["path"] for r in wanted.select("path").limit(most + 1).collect()]
    if not paths:
        return spark.createDataFrame([], LISTING)
    if len(paths) <= most:
        return named(spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?,])", r"\\\1", p) for p in paths]))
    since = wanted.agg(F.min("mtime_ns")).first()[0]
    return read_files(spark, directory, since).join(wanted.select("path"), "path", "left_semi")


def segments(path: Column, directory: str) -> Column:
    return F.split(F.substring(path, len(directory.rstrip("/")) + 2, 1 << 20), "/")


def not_skipped(path: Column, directory: str) -> Column:
    """Whether no part of a path below the directory is hidden, and none of its directories holds dependencies."""
    parts = segments(path, directory)
    hidden = F.exists(parts, lambda p: p.startswith("."))
    return under(path, directory) & ~hidden & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, DEPENDENCY_DIRS)))


def project_roots(paths: DataFrame, directory: str) -> DataFrame:
    """(root): the topmost directories with a marker among (path); marker directories count by the files in them."""
    parts = segments(F.col("path"), directory)
    place = F.array_position(F.transform(parts, lambda p: p.isin(*PROJECT_MARKERS)), True)
    # every prefix that ends before a marker is a directory with that marker
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).isin(*PROJECT_MARKERS))
    base = directory.rstrip("/")
    dirs = F.transform(at, lambda i: F.concat_ws("/", F.lit(base), F.slice(parts, F.lit(1), i)))
    clean = F.filter(dirs, lambda d: (d == base) | (d == base + "/") | not_skipped(F.concat(d, F.lit("/x")), base))
    marked = paths.where(under(F.col("path"), base) & (place > 0)).select(F.explode(clean).alias("root")).select(F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    above = marked.select(F.explode(ancestors(F.col("root"))).alias("dir"), "root").join(marked.select(F.col("root").alias("dir")), "dir", "left_semi").select("root")
    return marked.join(above, "root", "left_anti")


def ancestors(path: Column) -> Column:
    """The proper ancestor directories of a path; a join on them is a prefix join without comparing all pairs."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def walk(files: DataFrame, directory: str) -> DataFrame:
    """The files to index: neither skipped nor within a project, unless the directory itself is one."""
    base = directory.rstrip("/")
    kept = files.where(not_skipped(F.col("path"), base))
    roots = project_roots(files.select("path"), base).where(F.col("root") != base)
    inside = kept.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots, "root", "left_semi").select("path").distinct()
    return kept.join(inside, "path", "left_anti")


def summary_files(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """The listed files that describe a project root."""
    rows = listed.where(basename(F.col("path")).isin(*SUMMARY_FILES, "package.json", "pyproject.toml"))
    return rows.withColumn("root", parent(F.col("path"))).join(roots, "root", "left_semi").drop("root")


def project_summaries(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, summary): readme texts, package name and description, and project file of each root."""
    name, text = basename(F.col("path")), F.decode("content", "UTF-8")
    order = F.when(name.isin(*SUMMARY_FILES), F.array_position(F.array(*map(F.lit, SUMMARY_FILES)), name)).when(name == "package.json", 10).when(name == "pyproject.toml", 11)
    package = F.concat_ws("\n", F.concat(F.lit("name: "), F.get_json_object(text, "$.name")), F.concat(F.lit("description: "), F.get_json_object(text, "$.description")))
    body = F.when(name == "package.json", package).when(name == "pyproject.toml", F.substring(text, 1, 1000)).otherwise(F.substring(text, 1, 3000))
    rows = files.where(order.isNotNull()).select(parent(F.col("path")).alias("root"), order.alias("order"), F.concat(F.lit("["), name, F.lit("]\n"), body).alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("order", "part")))  # six files at most
    return rows.join(roots, "root", "left_semi").groupBy("root").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("summary"))
