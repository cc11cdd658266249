"""The jobs of a document index: build, search, tag, find duplicates, refresh."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.classify import RULES, classify, header_hex
from docloom.functions.text import compact_text, is_tabular, stored_text, volume_label
from docloom.operators import catalog, chunking, clusters, duplicates, models, search, tagging
from docloom.operators.catalog import Catalog, Conflict
from docloom.operators.vectors import document_vectors
from docloom.sources import extract, files

T = TypeVar("T")
EMBEDDER = "hashing-64"
DIMENSION = 64
#: Seconds after which a refresh that has not ended counts as broken off.
BUSY_S = 6 * 3600


def embedder() -> models.Embedder:
    return models.hashing_embedder(DIMENSION)


def start_run(db: Catalog, directory: str, model: str) -> int:
    """The number of a run whose entry is published; another that starts at the same moment gets the next one."""
    while True:
        db.begin()
        runs = db.read("index_runs")
        run_id = (runs.agg(F.max("id")).first()[0] or 0) + 1
        run = db.spark.range(1).select(F.lit(run_id).cast("long").alias("id"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit(directory).alias("target_dir"), F.lit(model).alias("model_name"), F.lit(DIMENSION).alias("model_dimension"), F.lit(None).cast("string").alias("stats_json"))
        db.write("index_runs", runs.unionByName(run))
        try:
            db.publish()
            return run_id
        except Conflict:
            continue


def from_what_is_current(db: Catalog, work: Callable[[], T]) -> T:
    """work over one manifest, and its publication; anew, if others published a table that it replaces."""
    while True:
        db.begin()
        try:
            out = work()
            db.publish()
            return out
        except Conflict:
            continue
        except BaseException:
            db.rollback()
            raise


def build_index(db: Catalog, directory: str, force: bool = False, load: Callable[[], models.Embedder] = embedder, model: str = EMBEDDER, rules: tuple = RULES) -> dict[str, int]:
    """Indexes a directory: new and changed files are extracted, chunked and embedded; files that are gone become ghosts.

    A run is published when it starts and, with all its tables at once, when it ends: a run that fails changes no table
    but its own entry, and the next one finds the same files to do. Runs at the same time lose nothing: who ends second
    begins anew from what the first has published. Only contents of new and changed files are read.
    """
    run_id = start_run(db, directory, model)
    return from_what_is_current(db, lambda: index_directory(db, directory, run_id, force, load, model, rules))


def index_directory(db: Catalog, directory: str, run_id: int, force: bool, load: Callable[[], models.Embedder], model: str, rules: tuple) -> dict[str, int]:
    spark = db.spark
    listed = db.scratch(files.read_files(spark, directory).drop("content"))
    roots = db.scratch(files.project_roots(listed.select("path"), directory))
    found = db.scratch(files.walk(listed, directory))
    before = db.read("documents")
    known_models = db.read("embedding_models").select("id", F.col("model_name").alias("name"))
    model_row = known_models.where(F.col("name") == model).first()
    if model_row is None:
        with_new = catalog.with_ids(known_models, spark.range(1).select(F.lit(model).alias("name")), write=db.scratch)
        model_row = db.write("embedding_models", with_new.select("id", F.col("name").alias("model_name"), F.lit(DIMENSION).alias("dimension"), F.lit(True).alias("normalized"))).where(F.col("model_name") == model).first()
    model_id = model_row["id"]
    work = db.scratch(catalog.changed(found, before, db.read("embeddings").where(F.col("model_id") == model_id), force))
    contents = files.read_listed(spark, directory, work)
    kinds = contents.select("path", classify(F.col("path"), header_hex(F.col("content")), rules)["basic_type"].alias("new_type"))
    known = before.select("path", F.col("basic_type").alias("old_type"))
    seen = found.join(kinds, "path", "left").join(known, "path", "left").select("path", "size_bytes", "mtime_ns", F.coalesce("new_type", "old_type").alias("basic_type"), volume_label(F.col("path")).alias("volume_label"))
    projects = roots.select(F.col("root").alias("path"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("mtime_ns"), F.lit("project").alias("basic_type"), volume_label(F.col("root")).alias("volume_label"))
    documents = db.write("documents", catalog.mark_ghosts(catalog.upsert_documents(before, seen.unionByName(projects), run_id, db.scratch), run_id, directory))
    ids = documents.select(F.col("id").alias("document_id"), "path")
    texts = extract.extract(contents).where("status <> 'unsupported'").join(ids, "path").withColumn("created_at", F.current_timestamp())
    described = files.read_listed(spark, directory, files.summary_files(listed, roots))
    summaries = files.project_summaries(described, roots).join(ids.withColumnRenamed("path", "root"), "root").select("document_id", F.lit("project-summary").alias("extractor_name"), F.when(F.col("summary") == "", "no_text").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"), F.col("summary").alias("full_text"), F.length("summary").cast("long").alias("char_count"), F.current_timestamp().alias("created_at"))
    columns = ["document_id", "extractor_name", "status", "error", "full_text", "char_count", "created_at"]
    staged = db.scratch(texts.select(columns))  # whole texts, for the chunks
    kept = staged.withColumn("full_text", stored_text(F.col("full_text")))
    db.write("extractions", catalog.replace_content(db.read("extractions"), kept.unionByName(summaries.select(columns))))
    good = staged.where("status = 'success'").select("document_id", "extractor_name", F.col("full_text").alias("text"))
    plain = chunking.chunk_text(good.where(~is_tabular(F.col("extractor_name"))), key="document_id")
    tables = chunking.chunk_tabular(good.where(is_tabular(F.col("extractor_name"))), key="document_id")
    fresh_chunks = db.scratch(chunking.sample_evenly(db.scratch(plain.unionByName(tables)), "document_id", "chunk_index", write=db.scratch))
    redone = staged.select("document_id").distinct()
    old_chunks, embeddings = db.read("chunks"), db.read("embeddings")
    fresh = catalog.check_vectors(fresh_chunks, models.embed_chunks(fresh_chunks, load, model_id), DIMENSION)
    if staged.head() is not None:
        db.write("chunks", old_chunks.join(redone, "document_id", "left_anti").unionByName(fresh_chunks))
        db.write("embeddings", embeddings.join(redone, "document_id", "left_anti").unionByName(fresh.select(embeddings.columns)))
        catalog.index_texts(db, "text", "postings", old_chunks.join(redone, "document_id", "left_semi"), fresh_chunks, redone)
        catalog.index_vectors(db, model_id, db.read("embeddings").where(F.col("model_id") == model_id).join(redone, "document_id", "left_semi").select("document_id", "chunk_index", "vector"))
    status = {r["status"]: r["n"] for r in staged.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    scanned, todo = found.count(), work.count()
    stats = {"scanned": scanned, "indexed": sum(status.values()), "success": status.get("success", 0), "no_text": status.get("no_text", 0), "error": status.get("error", 0), "unsupported": todo - sum(status.values()), "skipped_unchanged": scanned - todo, "chunk_count": fresh_chunks.count(), "project_count": roots.count(), "removed": before.where("is_present").join(documents.where("not is_present").select("id"), "id", "left_semi").count()}
    own = F.col("id") == run_id
    db.update("index_runs", lambda runs: runs.withColumns({"ended_at": F.when(own, F.current_timestamp()).otherwise(F.col("ended_at")), "stats_json": F.when(own, F.lit(json.dumps(stats))).otherwise(F.col("stats_json"))}))
    return stats


#: Legs of text, and their postings.
TEXT_LEGS = {"text": "postings", "tags": "tag_postings"}


def text_leg(db: Catalog, leg: str, query: str, present: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_index, score, rank) of a leg of text by its postings; no text is read.

    Statistics cover all chunks; hits of documents that are not among present (doc_id) are left out afterwards.
    """
    parsed = search.parse(query)
    if parsed is None or not parsed.any_of:
        return db.spark.createDataFrame([], "doc_id long, chunk_index int, score double, rank int")
    hits, n = catalog.text_hits(db, leg, TEXT_LEGS[leg], parsed)
    return search.best_chunks(hits if present is None else hits.join(present, "doc_id", "left_semi"), n)


def named_tags(db: Catalog) -> DataFrame:
    """(document_id, name, confidence, at) of all tags."""
    return db.read("document_tags").join(db.read("tags").select(F.col("id").alias("tag_id"), "name"), "tag_id").select("document_id", "name", "confidence", "at")


def search_documents(db: Catalog, query: str, top_k: int = search.TOP_K, candidates: int = search.CANDIDATES, floor: float = search.FLOOR, load: Callable[[], models.Embedder] = embedder, model: str = EMBEDDER, reranker: Callable[[], search.Reranker] | None = None) -> DataFrame:
    """(path, score, chunk_index, text), best first."""
    return search_with_statistics(db, query, top_k, candidates, floor, load, model, reranker)[0]


def search_vectors(db: Catalog, query: str, top_k: int = search.TOP_K, load: Callable[[], models.Embedder] = embedder, model: str = EMBEDDER) -> tuple[DataFrame, dict[str, int]]:
    """(path, score, chunk_index) of the documents nearest to a query, best first, and what was opened of the clusters of vectors."""
    db.begin()
    known = db.read("embedding_models").where(F.col("model_name") == model).first()
    if known is None:
        raise ValueError(f"no vectors of the model {model}")
    documents = db.read("documents").where("is_present").select(F.col("id").alias("document_id"), "path")
    versions = db.read("versions").where(F.col("leg") == "text").select("document_id", "version")
    good = db.read("extractions").where("status = 'success'").select("document_id")
    members = db.read("clustered_vectors").where(F.col("model_id") == known["id"]).join(versions, ["document_id", "version"], "left_semi").join(documents, "document_id", "left_semi").join(good, "document_id", "left_semi")
    rows, stats = clusters.nearest(members, db.read("vector_centres").where(F.col("model_id") == known["id"]), load()([query])[0].tolist(), top_k)
    db.rollback()
    return rows.join(documents.withColumnRenamed("document_id", "doc_id"), "doc_id").orderBy("rank").select("path", "score", "chunk_index"), stats


def search_with_statistics(db: Catalog, query: str, top_k: int = search.TOP_K, candidates: int = search.CANDIDATES, floor: float = search.FLOOR, load: Callable[[], models.Embedder] = embedder, model: str = EMBEDDER, reranker: Callable[[], search.Reranker] | None = None) -> tuple[DataFrame, dict]:
    """The results, and counts and seconds of each step. Text statistics cover all chunks; hits of absent documents are left out afterwards."""
    db.begin()
    known = db.read("embedding_models").where(F.col("model_name") == model).first()
    if known is None:
        raise ValueError(f"no vectors of the model {model}")
    clock = [time.monotonic()]

    def lap() -> float:
        clock.append(time.monotonic())
        return clock[-1] - clock[-2]

    documents, chunks = db.read("documents"), db.read("chunks").withColumnRenamed("document_id", "doc_id")
    vector = load()([query])[0].tolist()
    stats: dict = {"query_embed_seconds": lap()}
    vectors = catalog.searchable(documents, db.read("extractions"), db.read("chunks"), db.read("embeddings"), known["id"])
    present = documents.where("is_present").select(F.col("id").alias("doc_id"))
    stats["chunk_count"] = vectors.count()
    parts = []
    for name, count, leg in (("vector", "dense", lambda: search.dense_leg(vectors, vector, write=db.scratch)), ("keyword", "sparse", lambda: text_leg(db, "text", query, present)), ("tag", "tag", lambda: text_leg(db, "tags", query, present))):
        parts.append(db.scratch(leg()))
        stats |= {f"{count}_hit_count": parts[-1].count(), f"{name}_search_seconds": lap()}
    pooled = db.scratch(search.pool(search.fuse(*parts), candidates))
    wanted = [r["doc_id"] for r in pooled.select("doc_id").collect()]  # at most the candidates: a filter of the scans
    texts = search.with_text(pooled, chunks.where(F.col("doc_id").isin(wanted)), tagging.tags_text(named_tags(db).where(F.col("document_id").isin(wanted))).withColumnRenamed("document_id", "doc_id"), db.scratch)
    scored = db.scratch(search.scored_by(texts, query, reranker) if reranker else texts.withColumn("snippet", compact_text(F.col("text"))).withColumn("score", search.lexical_score(query)))
    seen = scored.agg(F.count(F.lit(1)).alias("pool"), F.max("score").alias("top"), F.count_if(F.col("score") >= floor).alias("over")).first()
    stats |= {"candidate_pool_size": seen["pool"], "top1_score": seen["top"], "document_count": seen["over"], "rerank_seconds": lap()}
    rows = search.best(scored, floor, top_k).join(documents.select(F.col("id").alias("doc_id"), "path"), "doc_id")
    db.rollback()
    return rows.select("path", "score", "chunk_index", "text").orderBy(F.col("score").desc(), "path"), stats


def tag(db: Catalog, tagger: tagging.Tagger | None = tagging.frequent_words, force: bool = False, load: Callable[[], models.Embedder] = embedder, model: str = EMBEDDER, project_tagger: tagging.ProjectTagger = tagging.project_words) -> dict[str, int]:
    """Tags what is pending, scores tags by the vectors of documents, and gives basic tags to what has no text; ten counters.

    Without a tagger (it is not healthy) only basic tags are given, and what is pending stays so.
    """
    return from_what_is_current(db, lambda: tag_pending(db, tagger, project_tagger, force, load, model))


def tag_pending(db: Catalog, tagger: tagging.Tagger | None, project_tagger: tagging.ProjectTagger, force: bool, load: Callable[[], models.Embedder], model: str) -> dict[str, int]:
    documents, extractions, old = db.read("documents"), db.read("extractions"), db.read("tagging_results")
    known = old.where("false") if force else old
    plain, projects = db.scratch(tagging.pending(documents, extractions, known)), db.scratch(tagging.pending(documents, extractions, known, projects=True))
    basic = tagging.basic_tags(documents, extractions, old, force)
    rows = basic if tagger is None else tagging.tag_documents(plain, tagger).unionByName(tagging.tag_projects(projects, project_tagger)).unionByName(basic)
    raw = db.scratch(rows)
    names = raw.where("status = 'tagged'").select(F.explode("tags").alias("t")).where("t.confidence < 1").select("t.name").distinct()
    embedded = models.embed_chunks(names.select(F.xxhash64("name").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("name").alias("text")), load, 0)
    of_names = names.join(embedded.select(F.col("document_id").alias("h"), F.col("vector").alias("tag_vector")), F.xxhash64("name") == F.col("h")).select("name", "tag_vector")
    model_row = db.read("embedding_models").where(F.col("model_name") == model).first()
    vectors = document_vectors(db.read("chunks"), db.read("embeddings"), model_row["id"] if model_row else 0)
    new = db.scratch(tagging.scored(raw, vectors, of_names).withColumn("created_at", F.current_timestamp()))
    clean = db.scratch(tagging.clean_tags(new))
    redone, named = new.select("document_id"), named_tags(db).select("document_id", "name", "at")
    texts = lambda rows: tagging.tags_text(rows).select("document_id", F.lit(-1).alias("chunk_index"), F.col("tags_text").alias("text"))
    if new.head() is not None:
        catalog.index_texts(db, "tags", "tag_postings", db.scratch(texts(named.join(redone, "document_id", "left_semi"))), db.scratch(texts(clean)), redone)
    dictionary = db.write("tags", catalog.with_ids(db.read("tags"), clean.select("name"), write=db.scratch).withColumn("created_at", F.current_timestamp()))
    links = clean.join(dictionary.select(F.col("id").alias("tag_id"), "name"), "name").select("document_id", "tag_id", "confidence", "at")
    db.write("document_tags", db.read("document_tags").join(new.select("document_id"), "document_id", "left_anti").unionByName(links))
    db.write("tagging_results", catalog.upsert(old, new.select(old.columns), "document_id"))
    counts = {r["status"]: r["n"] for r in tagging.status_counts(new).collect()}
    n_plain, n_projects = plain.count(), projects.count()
    short = tagging.too_short(plain).count()
    given = 0 if tagger is None else n_plain + n_projects - short
    return {"pending": n_plain, "projects": n_projects, "too_short": short, "given": given, "tagged": counts.get("tagged", 0), "failed": given - counts.get("tagged", 0), "untagged": counts.get("untagged", 0), "basic": counts.get("basic", 0), "tags": clean.count(), "total": sum(counts.values())}


def tags_report(db: Catalog, query: str | None = None) -> DataFrame:
    """All tagging results, newest first, or those whose tags match a query, by their BM25."""
    db.begin()
    names = named_tags(db)
    only = None if query is None else text_leg(db, "tags", query).select(F.col("doc_id").alias("document_id"), F.col("score").alias("bm25"))
    rows = tagging.tag_report(db.read("documents"), db.read("tagging_results"), names, only)
    db.rollback()
    return rows


def find_duplicates(db: Catalog, directory: str) -> DataFrame:
    """(sha256, path, size, mtime, keep, keeper) of files with equal contents."""
    return duplicates.members(hashed_files(db, directory))


def hashed_files(db: Catalog, directory: str) -> DataFrame:
    """(path, size, mtime, sha256) of files whose size another file has; only contents of such sizes are read."""
    listed = db.scratch(files.walk(files.read_files(db.spark, directory).drop("content"), directory))
    several = db.scratch(duplicates.same_size(listed.select("path", F.col("size_bytes").alias("size"), F.col("mtime_ns").alias("mtime"))))
    rows = several.join(files.read_listed(db.spark, directory, several.withColumnRenamed("mtime", "mtime_ns")).select("path", "content"), "path")
    return rows.withColumn("sha256", F.sha2("content", 256)).drop("content")


def plan_cleanup(db: Catalog, directory: str, log: str, decisions: DataFrame | None = None) -> DataFrame:
    """The clean-up plan of a directory, appended to a log of JSON lines; nothing is deleted here."""
    plan = db.scratch(duplicates.cleanup_plan(db.scratch(hashed_files(db, directory)), decisions))
    duplicates.append_log(plan.withColumns({"timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "restored_path": F.lit(None).cast("string")}), log)
    return plan


def plan_undo(db: Catalog, log: str, trash_dirs: list[str], directory: str) -> DataFrame:
    """What of the log's removals can be restored from the given trash folders."""
    listed = files.read_files(db.spark, directory).select("path")
    return duplicates.undo_plan(duplicates.read_log(db.spark, log), duplicates.trash_files(db.spark, trash_dirs), listed)


def refresh(db: Catalog, directories: list[str], tagger: tagging.Tagger = tagging.frequent_words, healthy: Callable[[], bool] = lambda: True, min_gap_s: float = 0.0, busy_s: float = BUSY_S) -> list[dict]:
    """Builds each directory's index and the tags; one that fails does not stop the others.

    A directory is left out (``throttled``) if its last good refresh began less than ``min_gap_s`` ago, and (``busy``) if
    another began within ``busy_s`` and has not ended. Every attempt has an entry in ``refresh_runs``. If the tagger is not
    healthy, only basic tags are given; the number of documents that stay pending is in the last entry's ``pending``.
    """
    out = []
    for d in directories:
        status = claim(db, d, min_gap_s, busy_s)
        if status != "running":
            out.append({"directory": d, "status": status})
            continue
        try:
            entry = {"directory": d, "status": "ok", **build_index(db, d)}
        except Exception as e:  # each directory stands for itself
            entry = {"directory": d, "status": f"error: {type(e).__name__}"}
            db.rollback()
        out.append(entry)
        own = (F.col("directory") == d) & F.col("ended_at").isNull()
        done = {"status": F.lit(entry["status"]), "ended_at": F.current_timestamp(), "stats_json": F.lit(json.dumps(entry))}
        db.update("refresh_runs", lambda runs, own=own, done=done: runs.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in done.items()}))
        db.publish()
    counts = tag(db, tagger if healthy() else None)
    if out:
        out[-1]["pending"] = 0 if healthy() else counts["pending"] + counts["projects"]
    return out


def claim(db: Catalog, directory: str, min_gap_s: float, busy_s: float) -> str:
    """``running`` if this refresh of a directory may begin, which is then published; else why not.

    Two that look at the same moment cannot both begin: the second one's publication is a conflict, and it looks again.
    """
    while True:
        db.begin()
        runs = db.read("refresh_runs")
        age = (F.unix_micros(F.current_timestamp()) - F.unix_micros("started_at")) / 1e6
        last = runs.where(F.col("directory") == directory).select(F.min(F.when(F.col("status") == "ok", age)).alias("ok"), F.min(F.when(F.col("ended_at").isNull(), age)).alias("open")).first()
        if last["open"] is not None and last["open"] < busy_s:
            return "busy"
        if last["ok"] is not None and last["ok"] < min_gap_s:
            return "throttled"
        db.write("refresh_runs", runs.where((F.col("directory") != directory) | F.col("ended_at").isNotNull()).unionByName(refresh_row(db, directory, "running", False)))
        try:
            db.publish()
            return "running"
        except Conflict:
            continue


def refresh_row(db: Catalog, directory: str, status: str, ended: bool, stats: str | None = None) -> DataFrame:
    now = F.current_timestamp()
    return db.spark.range(1).select(F.lit(directory).alias("directory"), F.lit(status).alias("status"), now.alias("started_at"), (now if ended else F.lit(None).cast("timestamp")).alias("ended_at"), F.lit(stats).cast("string").alias("stats_json"))
