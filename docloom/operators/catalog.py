"""The tables of the index: Parquet snapshots behind manifests, upserts, ghosts, incremental selection."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import under
from docloom.operators import clusters, postings, search
from docloom.operators.tables import Write, numbered, written

SCHEMAS = {
    "index_runs": "id long, started_at timestamp, ended_at timestamp, target_dir string, model_name string, model_dimension int, stats_json string",
    "documents": "id long, path string, size_bytes long, mtime_ns long, basic_type string, volume_label string, is_present boolean, last_seen_run_id long",
    "extractions": "document_id long, extractor_name string, status string, error string, full_text string, char_count long, created_at timestamp",
    "chunks": "document_id long, chunk_index int, text string, start_offset int, end_offset int",
    "embedding_models": "id long, model_name string, dimension int, normalized boolean",
    "embeddings": "document_id long, chunk_index int, model_id long, dimension int, vector array<float>",
    "tags": "id long, name string, created_at timestamp",
    "tagging_results": "document_id long, confidence double, status string, reasoning string, created_at timestamp",
    "document_tags": "document_id long, tag_id long, confidence double, at int",
    "postings": postings.SCHEMA,
    "tag_postings": postings.SCHEMA,
    "versions": "leg string, document_id long, version long",
    "text_statistics": "leg string, version long, n long, size long",
    "clustered_vectors": "model_id long, cluster int, document_id long, chunk_index int, version long, distance double, vector array<float>",
    "vector_centres": f"model_id long, fitted_on long, {clusters.CENTRES}",
    "refresh_runs": "directory string, status string, started_at timestamp, ended_at timestamp, stats_json string",
}
PARTITIONS = {"postings": ["buckets", "bucket"], "tag_postings": ["buckets", "bucket"], "clustered_vectors": ["model_id", "cluster"]}
MANIFEST = re.compile(r"m=(\d{10})\.json")
#: The folders of each table.
Tables = dict[str, list[str]]


class Conflict(RuntimeError):
    """Another writer published a table that this one replaces."""


class Catalog:
    """Tables as Parquet folders of their own names, and manifests that say which folders are current for each.

    ``begin`` fixes the manifest that all reads see until ``publish`` or ``rollback``; without it a read sees the newest.
    ``write`` puts a table in a fresh folder, ``append`` adds a folder to a table, ``update`` changes what is current at
    publication; only this catalog sees them. ``publish`` makes all of them current at once by creating the next manifest, which
    only one writer can; who comes second looks again. A table that was replaced by others meanwhile is a ``Conflict``: the run
    begins anew from what is current, so nothing is lost. A run that fails leaves nothing behind that others see.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.snapshot: Tables | None = None
        self.rollback()

    def rollback(self) -> None:
        """Forgets what was written, and the manifest that reads saw."""
        self.snapshot = None
        self.replaced: dict[str, str] = {}
        self.added: dict[str, list[str]] = {}
        self.updates: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def begin(self) -> None:
        """From now on, reads see one manifest."""
        self.rollback()
        self.snapshot = self.newest()[1]

    def files(self):
        """The file system of the root, and its path class."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def newest(self) -> tuple[int, Tables]:
        """The number of the last manifest, and the folders of each table in it."""
        fs, path = self.files()
        folder = path(f"{self.root}/manifests")
        known = [m for s in (fs.listStatus(folder) if fs.exists(folder) else []) if (m := MANIFEST.fullmatch(s.getPath().getName()))]
        if not known:
            return 0, {}
        last = max(known, key=lambda m: int(m[1]))
        stream = fs.open(path(f"{self.root}/manifests/{last[0]}"))
        try:
            return int(last[1]), json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        if name in self.updates:
            return self.updates[name](self.open(name, self.folders(name)))
        return self.open(name, self.folders(name))

    def folders(self, name: str) -> list[str]:
        """The folders of a table as this catalog sees it."""
        seen = self.snapshot if self.snapshot is not None else self.newest()[1]
        return ([self.replaced[name]] if name in self.replaced else seen.get(name, [])) + self.added.get(name, [])

    def open(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        columns = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        base = {"basePath": f"{self.root}/{name}"} if name in PARTITIONS else {}
        return self.spark.read.schema(SCHEMAS[name]).options(**base).parquet(*[f"{self.root}/{f}" for f in folders]).select(columns)

    def store(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/segment=s{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]).write.parquet(f"{self.root}/{folder}", partitionBy=PARTITIONS.get(name))
        if self.snapshot is None:
            self.snapshot = self.newest()[1]
        return folder

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        self.replaced[name] = self.store(name, rows)
        self.added.pop(name, None)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> None:
        self.added.setdefault(name, []).append(self.store(name, rows))

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """A change of a small table that holds whatever others published: it is made at publication, of what is current then."""
        self.updates[name] = change

    def scratch(self, rows: DataFrame) -> DataFrame:
        """rows in a folder of no table."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def publish(self) -> None:
        """Makes the written tables current."""
        made: dict[str, tuple[list[str], str]] = {}
        while True:
            number, now = self.newest()
            if lost := [n for n in self.replaced if self.snapshot is not None and now.get(n, []) != self.snapshot.get(n, [])]:
                raise Conflict(f"published by others meanwhile: {', '.join(sorted(lost))}")
            merged = now | {n: [f] for n, f in self.replaced.items()}
            merged |= {n: merged.get(n, []) + fs for n, fs in self.added.items()}
            for name, change in self.updates.items():
                if name not in made or made[name][0] != now.get(name, []):
                    made[name] = now.get(name, []), self.store(name, change(self.open(name, now.get(name, []))))
                merged[name] = [made[name][1]]
            if self.create(f"{self.root}/manifests/m={number + 1:010d}.json", json.dumps(merged)):
                return self.rollback()

    def create(self, target: str, content: str) -> bool:
        """Whether a file was created whole, which is so for one writer only."""
        fs, path = self.files()
        draft = f"{self.root}/scratch/{uuid.uuid4().hex}.json"
        out = fs.create(path(draft), True)
        out.writeBytes(content)
        out.close()
        fs.mkdirs(path(target).getParent())
        if fs.getUri().getScheme() == "file":  # its rename would replace a file
            local = lambda p: path(p).toUri().getPath()
            try:
                os.link(local(draft), local(target))
            except FileExistsError:
                return False
            return True
        return self.rename(draft, target)

    def rename(self, draft: str, target: str) -> bool:
        """A rename that never replaces a file: one step in HDFS; a store without such a rename needs a single writer."""
        sc = self.spark.sparkContext
        _, path = self.files()
        options = sc._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), sc._jsc.hadoopConfiguration()).rename(path(draft), path(target), sc._gateway.new_array(options, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_documents(old: DataFrame, seen: DataFrame, run_id: int, write: Write = written) -> DataFrame:
    """Documents after a scan saw (path, size_bytes, mtime_ns, basic_type, volume_label); known paths keep their id, new ones are numbered onwards."""
    seen = seen.withColumns({"is_present": F.lit(True), "last_seen_run_id": F.lit(run_id).cast("long")}).dropDuplicates(["path"])
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ids = old.select("path", "id").unionByName(numbered(seen.select("path").join(old, "path", "left_anti"), ["path"], "id", last, write))
    return upsert(old, seen.join(ids, "path").select(old.columns), "path")


def replace_content(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Content rows after documents were extracted anew: all rows of a document are replaced."""
    return upsert(old, new, key)


def is_ghost(run_id: int, directory: str | None = None) -> Column:
    """Whether a present document was not seen by a run over the directory."""
    out = F.col("is_present") & ~F.col("last_seen_run_id").eqNullSafe(F.lit(run_id))
    return out if directory is None else out & under(F.col("path"), directory)


def mark_ghosts(documents: DataFrame, run_id: int, directory: str | None = None) -> DataFrame:
    return documents.withColumn("is_present", F.col("is_present") & ~is_ghost(run_id, directory))


def changed(files: DataFrame, documents: DataFrame, embedded: DataFrame, force: bool = False) -> DataFrame:
    """The files that need extraction: new, of other size or time, or without vectors of this model."""
    if force:
        return files
    known = documents.join(embedded.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi").select("path", "size_bytes", "mtime_ns")
    same = (F.col("f.path") == F.col("k.path")) & F.col("f.size_bytes").eqNullSafe(F.col("k.size_bytes")) & F.col("f.mtime_ns").eqNullSafe(F.col("k.mtime_ns"))
    return files.alias("f").join(known.alias("k"), same, "left_anti")


def present_paths(documents: DataFrame, directory: str | None = None) -> DataFrame:
    rows = documents.where("is_present")
    return (rows if directory is None else rows.where(under(F.col("path"), directory))).select("path")


def target_dirs(runs: DataFrame) -> DataFrame:
    return runs.where("target_dir is not null").select("target_dir").distinct().orderBy("target_dir")


def searchable(documents: DataFrame, extractions: DataFrame, chunks: DataFrame, embeddings: DataFrame, model_id: int) -> DataFrame:
    """(doc_id, chunk_index, text, vector) of present, well extracted documents under a model."""
    ok = documents.where("is_present").select(F.col("id").alias("document_id")).join(extractions.where("status = 'success'").select("document_id"), "document_id")
    vectors = embeddings.where(F.col("model_id") == model_id).select("document_id", "chunk_index", "vector")
    return chunks.join(ok, "document_id", "left_semi").join(vectors, ["document_id", "chunk_index"]).select(F.col("document_id").alias("doc_id"), "chunk_index", "text", "vector")


def with_ids(known: DataFrame, names: DataFrame, key: str = "name", write: Write = written) -> DataFrame:
    """(id, key): known entries and new ones, numbered onwards in the order of the key."""
    new = names.select(key).where(F.trim(key) != "").distinct().join(known, key, "left_anti")
    start = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.select("id", key).unionByName(numbered(new, [key], "id", start, write).select(F.col("id").cast("long"), key))


def index_texts(db: Catalog, leg: str, table: str, before: DataFrame, after: DataFrame, redone: DataFrame) -> None:
    """Keeps a leg's postings and statistics: documents of redone (document_id) had the texts before and have those after.

    before and after are (document_id, chunk_index, text). A segment is added; versions and statistics are replaced.
    """
    known = {r["leg"]: r for r in db.read("text_statistics").collect()}  # a row for each leg
    own = known.get(leg)
    version = (own["version"] if own else 0) + 1
    gone, come = postings.statistics(before), postings.statistics(after)
    n, size = (own["n"] - gone[0], own["size"] - gone[1]) if own else (0, 0)
    rows = [tuple(r) for k, r in known.items() if k != leg] + [(leg, version, n + come[0], size + come[1])]
    db.write("text_statistics", db.spark.createDataFrame(rows, SCHEMAS["text_statistics"]).coalesce(1))
    old, now = db.read("versions"), redone.select(F.lit(leg).alias("leg"), "document_id", F.lit(version).cast("long").alias("version"))
    others = old.join(now.select("leg", "document_id"), ["leg", "document_id"], "left_anti")
    versions = db.write("versions", others.unionByName(now)).where(F.col("leg") == leg)
    new = postings.post(after, version, come[1])
    if len(db.folders(table)) < postings.MOST_SEGMENTS:
        db.append(table, postings.laid_out(new))
    else:  # all postings that count, in one segment
        whole = postings.BASE ** postings.powers(size + come[1])
        living = db.read(table).join(versions, ["document_id", "version"], "left_semi").unionByName(new)
        db.write(table, postings.laid_out(living.withColumns({"buckets": F.lit(whole), "bucket": postings.bucket(F.col("trigram"), whole)})))


def index_vectors(db: Catalog, model_id: int, fresh: DataFrame) -> None:
    """Adds new vectors (document_id, chunk_index, vector) to the clusters of their model; fits centres anew once they are many times as many.

    Comes after ``index_texts``, whose versions say which vectors count.
    """
    versions = db.read("versions").where(F.col("leg") == "text").select("document_id", "version")
    old = db.read("vector_centres")
    rows = old.where(F.col("model_id") == model_id).orderBy("cluster").collect()  # a row for each cluster
    come = fresh.join(versions, "document_id").select(F.lit(model_id).cast("long").alias("model_id"), "document_id", "chunk_index", "version", "vector")
    n = sum(r["n"] for r in rows) + come.count()
    if not n:
        return
    refit = not rows or n >= clusters.GROWTH * rows[0]["fitted_on"]
    members = db.read("clustered_vectors").where(F.col("model_id") == model_id).join(versions, ["document_id", "version"], "left_semi").select(come.columns)
    every = db.scratch(members.unionByName(come)) if refit else come
    centres = clusters.fit(every, n) if refit else np.array([r["centre"] for r in rows])
    placed = db.scratch(clusters.assigned(every, centres).hint("rebalance", "cluster"))
    spread = clusters.spread(placed, centres, None if refit else {r["cluster"]: (r["radius"], r["n"]) for r in rows})
    others = old.where(F.col("model_id") != model_id)
    db.write("vector_centres", others.unionByName(spread.select(F.lit(model_id).cast("long").alias("model_id"), F.lit(n if refit else rows[0]["fitted_on"]).cast("long").alias("fitted_on"), "*")))
    if refit:
        db.write("clustered_vectors", db.read("clustered_vectors").where(F.col("model_id") != model_id).unionByName(placed.select(db.read("clustered_vectors").columns)))
    else:
        db.append("clustered_vectors", placed)


def text_hits(db: Catalog, leg: str, table: str, query: search.Phrases) -> tuple[DataFrame, int]:
    """(doc_id, chunk_index, bm25) of a leg, from its postings and statistics alone, and at most how many rows they are."""
    own = db.read("text_statistics").where(F.col("leg") == leg).first()
    versions = db.read("versions").where(F.col("leg") == leg).select("document_id", "version")
    return postings.bm25(db.read(table), versions, own["n"] if own else 0, own["size"] if own else 0, query, db.scratch)


def clear_tags(db: Catalog) -> None:
    """Empties all tables of tags, at once."""
    db.begin()
    for name in ("tags", "tagging_results", "document_tags", "tag_postings"):
        db.write(name, db.read(name).where("false"))
    for name in ("versions", "text_statistics"):
        db.write(name, db.read(name).where(F.col("leg") != "tags"))
    db.publish()


def check_vectors(chunks: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """embeddings, failing where a vector has another dimension or a chunk has none."""
    rows = chunks.select("document_id", "chunk_index").join(embeddings, ["document_id", "chunk_index"], "left")
    bad = F.col("vector").isNull() | (F.size("vector") != dimension)
    return rows.withColumn("vector", F.when(bad, F.raise_error(F.lit("a chunk without a vector of the model's dimension"))).otherwise(F.col("vector")))
