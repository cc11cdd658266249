"""The index under edits and several writers: postings, statistics, clusters, manifests, ids, and what is opened."""

import os
import random
import threading

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from docloom.operators import catalog, chunking, clusters, postings, search, tables
from docloom.operators.catalog import Catalog, Conflict
from docloom.operators.tables import numbered, positions
from docloom.plans import engine
from docloom.sources import files

QUERIES = ("apples", "app", "aaaa", "abab", '"s and p"', "apples pears", "apples OR pears", "apples NOT pears", "apples NOT apples", "apples NOT apples OR pears", "äpfel", "ab", "ÄPFEL zz", "nowhere", '"a.b"', "日本語", "pears OR (")


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    words = ["apples", "pears", "and", "aaaaaa", "ababab", "Äpfel", "日本語の", "a.b", "İstanbul", "x", "figs"]
    rows = [(i // 3, i % 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(200, 0, None), (201, 0, "")]
    return spark.createDataFrame(rows, "document_id long, chunk_index int, text string").repartition(3).cache()


@pytest.mark.parametrize("query", QUERIES)
def test_postings_find_and_score_as_a_scan_does(spark, chunks, query):
    parsed = search.parse(query)
    if parsed is None or not parsed.any_of:
        return
    known = chunks.where("text is not null")
    index = postings.laid_out(postings.post(chunks, 1, 10**9)).cache()  # several buckets
    n, size = postings.statistics(chunks)
    got = postings.bm25(index, known.select("document_id", F.lit(1).cast("long").alias("version")).distinct(), n, size, parsed)[0]
    want = search.bm25(known.select(F.col("document_id").alias("doc_id"), "chunk_index", "text"), parsed)[0]
    pairs = lambda rows: {(r["doc_id"], r["chunk_index"]): round(r["bm25"], 9) for r in rows.collect()}
    assert pairs(got) == pairs(want)


@pytest.mark.parametrize("query", ["aaaa", '"s and p"', "apples OR pears", "apples NOT pears", "äpfel", "日本語", "nowhere"])
def test_packed_postings_find_and_score_as_a_scan_does(spark, chunks, query):
    far = F.col("document_id") * F.when(F.col("document_id") % 2 == 0, -(1 << 40)).otherwise((1 << 55) + 1)
    known = chunks.where("text is not null").withColumns({"document_id": far, "chunk_index": F.col("chunk_index") - 1})
    index = tables.written(postings.packed(known.unionByName(known.limit(9).withColumn("document_id", F.lit(None).cast("long"))), 1), **postings.PAGES)
    got = postings.bm25(index, known.select("document_id", F.lit(1).cast("long").alias("version")).distinct(), *postings.statistics(known), search.parse(query))[0]
    want = search.bm25(known.select(F.col("document_id").alias("doc_id"), "chunk_index", "text"), search.parse(query))[0]
    pairs = lambda rows: {(r["doc_id"], r["chunk_index"]): round(r["bm25"], 9) for r in rows.collect()}
    assert pairs(got) == pairs(want) and got.columns == ["doc_id", "chunk_index", "bm25"]


def test_packed_postings_are_those_that_are_not(spark, chunks):
    rows = lambda x: sorted((r["trigram"], r["document_id"], r["chunk_index"], r["version"], r["size"], *r["positions"]) for r in x.collect())
    packed = postings.packed(chunks, 3)
    assert rows(postings.unpacked(packed)) == rows(postings.post(chunks, 3))
    assert packed.count() < postings.post(chunks, 3).count() / 10 and packed.columns != postings.post(chunks, 3).columns


def test_numbers_of_any_size_are_packed():
    values = np.array([0, 1, 127, 128, 1 << 14, (1 << 14) - 1, 1 << 40, (1 << 63) - 1, -1, -(1 << 63)], np.int64)
    first = np.array([0, 3, 4])
    assert (postings.unzigzag(postings.numbers(postings.varints(postings.zigzag(values), first))) == values).all()
    assert len(postings.varints(values, first)) == 3 and (postings.numbers(postings.varints(values, first)[1:]) == values[3:]).all()
    assert (postings.summed(postings.gaps(values, first), first, np.array([3, 1, 6])) == values).all()
    assert len(postings.numbers(postings.varints(values, first)[:0])) == 0


def write(folder, texts):
    folder.mkdir(exist_ok=True)
    for name, body in texts.items():
        (folder / name).write_text(body)


def full_count(db):
    return postings.statistics(db.read("chunks"))


def legs_agree(spark, db, query):
    """A leg by postings against one over the texts."""
    chunks = db.read("chunks").select(F.col("document_id").alias("doc_id"), "chunk_index", "text")
    rows = lambda leg: {(r["doc_id"], r["chunk_index"], round(r["score"], 9), r["rank"]) for r in leg.collect()}
    want = rows(search.keyword_leg(chunks, query))
    assert rows(engine.text_leg(db, "text", query)) == want
    return len(want)


def test_postings_and_statistics_follow_edits(spark, tmp_path, monkeypatch):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    write(src, {f"{i}.txt": f"apples number {i} and pears " * (i + 1) for i in range(6)})
    engine.build_index(db, str(src))
    stored = lambda: tuple(db.read("text_statistics").where("leg = 'text'").select("n", "size").first())
    assert stored() == full_count(db) and legs_agree(spark, db, "apples pears") == 6
    write(src, {"1.txt": "pears only, which were apples? no", "2.txt": "  \n ", "7.txt": "new apples"})
    (src / "3.txt").unlink()
    engine.build_index(db, str(src))
    assert stored() == full_count(db) and len(db.folders("postings")) == 2
    assert legs_agree(spark, db, "apples") == 6 and legs_agree(spark, db, "pears NOT number") == 1
    monkeypatch.setattr(postings, "MOST_SEGMENTS", 2)
    write(src, {"8.txt": "apples at last"})
    engine.build_index(db, str(src))
    assert len(db.folders("postings")) == 1 and stored() == full_count(db) and legs_agree(spark, db, "apples") == 7
    monkeypatch.undo()
    dead = db.read("postings").join(db.read("versions"), ["document_id", "version"], "left_anti")
    assert dead.count() == 0
    engine.tag(db)
    tags = engine.tagging.tags_text(engine.named_tags(db))
    assert tuple(db.read("text_statistics").where("leg = 'tags'").select("n", "size").first()) == postings.statistics(tags.select(F.col("tags_text").alias("text")))
    plan = engine.text_leg(db, "text", "apples")._jdf.queryExecution().toString()
    assert "/chunks/" not in plan
    catalog.clear_tags(db)
    assert engine.text_leg(db, "tags", "apples").count() == 0 and legs_agree(spark, db, "apples") == 7


def test_clusters_find_what_a_scan_finds(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 16))
    points = np.concatenate([m + 0.1 * rng.normal(size=(100, 16)) for m in middles] + [np.zeros((3, 16))])
    lengths = np.linalg.norm(points, axis=1, keepdims=True)
    points = np.divide(points, lengths, out=points, where=lengths > 0).astype(np.float32)
    rows = spark.createDataFrame([(i // 2, i % 2, [float(x) for x in p]) for i, p in enumerate(points)], "document_id long, chunk_index int, vector array<float>").repartition(4).cache()
    centres = clusters.fit(rows, rows.count())
    members = clusters.assigned(rows, centres).cache()
    spread = clusters.spread(members, centres)
    assert spread.agg(F.sum("n")).first()[0] == len(points)
    for q in [points[0], points[555], -points[7], np.zeros(16), np.ones(16)]:
        got, stats = clusters.nearest(members, spread, [float(x) for x in q], 10)
        want = search.dense_leg(rows.withColumnRenamed("document_id", "doc_id"), [float(x) for x in q], most=10)
        assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in want.select(got.columns).orderBy("rank").collect()]
        assert stats["vectors"] == len(points)
    assert clusters.nearest(members, spread, [float(x) for x in points[0]], 10)[1]["vectors_read"] < len(points) / 2


def test_vectors_of_an_index_follow_edits(spark, tmp_path):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    write(src, {f"{i}.txt": f"word{i} of fruit number {i}" for i in range(5)})
    engine.build_index(db, str(src))
    write(src, {"1.txt": "quite another text", "new.txt": "word1 of fruit number 1"})
    (src / "2.txt").unlink()
    engine.build_index(db, str(src))
    rows, stats = engine.search_vectors(db, "word1 of fruit number 1", 10)
    got = [(os.path.basename(r["path"]), round(r["score"], 5)) for r in rows.collect()]
    assert got[0] == ("new.txt", 1.0) and sorted(n for n, _ in got) == ["0.txt", "1.txt", "3.txt", "4.txt", "new.txt"]
    assert stats["clusters"] == db.read("vector_centres").count()


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    for d in ("a", "b"):
        write(tmp_path / d, {f"{d}{i}.txt": f"text {i} of {d}, about apples" for i in range(3)})
    errors = []

    def run(d):
        try:
            engine.build_index(Catalog(spark, root), str(tmp_path / d))
        except Exception as e:  # seen below
            errors.append(e)

    threads = [threading.Thread(target=run, args=(d,)) for d in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert errors == []
    db = Catalog(spark, root)
    ids = [r["id"] for r in db.read("documents").collect()]
    assert len(ids) == len(set(ids)) == 6 and db.read("chunks").count() == db.read("embeddings").count() == 6
    assert sorted(r["id"] for r in db.read("index_runs").where("ended_at is not null").collect()) == [1, 2]
    assert legs_agree(spark, db, "apples") == 6


def test_conflicts_and_snapshots(spark, tmp_path):
    row = lambda i: spark.createDataFrame([(i, "en", None)], "id long, name string, created_at timestamp")
    one, two, reader = (Catalog(spark, str(tmp_path / "db")) for _ in range(3))
    one.write("tags", row(1))
    one.publish()
    reader.begin()
    one.begin(), two.begin()
    one.write("tags", row(2)), two.write("tags", row(3)), two.write("chunks", spark.createDataFrame([], catalog.SCHEMAS["chunks"]))
    one.publish()
    with pytest.raises(Conflict, match="tags"):
        two.publish()
    assert reader.read("tags").first()["id"] == 1 and two.newest()[1].keys() == {"tags"}
    reader.rollback()
    assert reader.read("tags").first()["id"] == 2
    two.rollback()
    two.update("tags", lambda rows: rows.unionByName(row(9)))
    one.append("tags", row(7))
    one.publish()
    two.publish()
    assert sorted(r["id"] for r in reader.read("tags").collect()) == [2, 7, 9]
    assert not one.create(f"{one.root}/manifests/m={one.newest()[0]:010d}.json", "{}")
    (tmp_path / "x").write_text("x"), (tmp_path / "y").write_text("y")
    assert not one.rename(str(tmp_path / "x"), str(tmp_path / "y")) and one.rename(str(tmp_path / "x"), str(tmp_path / "z"))
    with pytest.raises(Py4JJavaError):
        one.rename(str(tmp_path / "none"), str(tmp_path / "n"))


def test_two_refreshes_do_not_both_begin(spark, tmp_path, monkeypatch):
    one, two = (Catalog(spark, str(tmp_path / "db")) for _ in range(2))
    publish, first = Catalog.publish, []

    def slow(self):
        if self is one and not first:
            first.append(engine.claim(two, "/d", 0.0, 100.0))
        publish(self)

    monkeypatch.setattr(Catalog, "publish", slow)
    assert (engine.claim(one, "/d", 0.0, 100.0), first) == ("busy", ["running"])


def test_ids_never_clash(spark, tmp_path):
    path = "/new.txt"
    clash = spark.range(1).select(F.xxhash64(F.lit(path))).first()[0] % 1000
    old = spark.createDataFrame([(clash, "/old.txt", 1, 1, "text", "x", True, 1)], catalog.SCHEMAS["documents"])
    seen = spark.createDataFrame([(p, 1, 1, "text", "x") for p in (path, "/old.txt", *(f"/{i}" for i in range(50)))], "path string, size_bytes long, mtime_ns long, basic_type string, volume_label string")
    rows = catalog.upsert_documents(old, seen, 2).collect()
    assert len({r["id"] for r in rows}) == len(rows) == 52 and {r["id"] for r in rows if r["path"] == "/old.txt"} == {clash}
    assert sorted(r["id"] for r in rows) == list(range(clash, clash + 52))


def test_a_run_opens_only_what_changed(spark, tmp_path):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    write(src, {"large.txt": "long words " * 6000, "odd {a}[b]*?,.txt": "a name of odd letters"})
    write(src / "proj", {"README.md": "short", "package.json": '{"name": "p"}', "code.py": "x = 1\n" * 20_000})
    assert engine.build_index(db, str(src))["success"] == 2
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, 20_000)
    try:
        assert engine.build_index(db, str(src))["skipped_unchanged"] == 2
        write(src, {"restored.txt": "an old file that came back"})
        os.utime(src / "restored.txt", (1, 1))
        assert engine.build_index(db, str(src))["success"] == 1
        assert engine.find_duplicates(db, str(src)).count() == 0
    finally:
        spark.conf.unset(key)
    wanted = files.read_files(spark, str(src)).drop("content").where("size_bytes < 100")
    assert {r["path"] for r in files.read_listed(spark, str(src), wanted, most=1).collect()} == {r["path"] for r in files.read_listed(spark, str(src), wanted).collect()}


def test_positions_span_tasks(spark):
    rows = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 < 10, F.lit(None)).otherwise("b").alias("g"), (F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions(rows, ["k"], ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("hot", "b", None):
        own = sorted((r["k"], r["at"], r["group_size"]) for r in got if r["g"] == g)
        assert [x[1] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}
    assert [r["n"] for r in numbered(rows.select("k"), ["k"], "n", 10).orderBy("k").collect()] == list(range(11, 5011))
    kept = chunking.sample_evenly(rows, "g", "k", 300).collect()
    ks = sorted(r["k"] for r in got if r["g"] == "hot")
    assert sorted(r["k"] for r in kept if r["g"] == "hot") == [ks[i * len(ks) // 300] for i in range(300)]
    assert sum(r["g"] is None for r in kept) == sum(r["g"] == "b" for r in kept) == 250
