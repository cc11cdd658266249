import io
import json
import sqlite3
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import catalogue
from docloom.functions import text as T
from docloom.functions.classify import classify
from docloom.operators import chunking, duplicates, search, tagging
from docloom.operators.catalog import Catalog
from docloom.plans import engine
from docloom.sources import extract
from docloom.streaming import refresh


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。!\t", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_chunks_cover_the_text(text, size, overlap):
    chunks = list(chunking.text_chunks(text, size, overlap))
    seen = set()
    for k, (i, value, a, b) in enumerate(chunks):
        assert i == k and text[a:b] == value == value.strip() and 0 < len(value) <= size
        seen.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in seen)
    assert [c[2] for c in chunks] == sorted(c[2] for c in chunks)


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("   ", []),
        ("a" * 800, [(0, 800)]),
        ("a" * 801, [(0, 800), (700, 801)]),
        ("a" * 500 + "\n" + "b" * 400, [(0, 500), (400, 901)]),
        ("a" * 450 + ". " + "b" * 500, [(0, 451), (450, 952)]),
    ],
)
def test_chunk_places(text, want):
    assert [(a, b) for _, _, a, b in chunking.text_chunks(text)] == want


def test_table_chunks():
    assert list(chunking.table_chunks("h\n")) == []
    two = "[sheet: a]\nx\ty\n1\t2\n\n[sheet: b]\nz\n3\n"
    assert [c[1] for c in chunking.table_chunks(two)] == ["x\ty\n1\t2", "z\n3"]
    assert [c[1] for c in chunking.table_chunks("h\n" + "r" * 900 + "\ns")] == ["h\n" + "r" * 900, "h\ns"]


def test_chunk_arguments(spark):
    with pytest.raises(ValueError):
        chunking.chunk_text(spark.range(1), 10, 10)


ROWS = ["one two three", "ONE two", "two three four five", "nothing here", "three three three", "fourteen one", "x"]
QUERIES = ["one", "three", "one zz", "zz", '"two three"', "one two", "one OR four", "three NOT two", "one AND zz", "a.b", "what's", '"open', "THREE", "one OR zz", "three AND", "een one"]


@pytest.mark.parametrize("q", QUERIES)
def test_keyword_leg_equals_fts5(spark, q):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='trigram')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(ROWS, 1))
    try:
        want = {i: s for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (q,))}
    except sqlite3.OperationalError:
        want = {}
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(ROWS, 1)], "doc_id long, chunk_index int, text string")
    got = {r["doc_id"]: r["score"] for r in search.keyword_leg(chunks, q).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_fusion_prefers_the_first_leg(spark):
    leg = lambda *ids: spark.createDataFrame([(d, 0, f"t{d}", i) for i, d in enumerate(ids)], "doc_id long, chunk_index int, text string, rank int")
    got = search.pool(search.fuse(leg(1, 2), leg(2, 1), leg(3))).collect()
    assert [(r["doc_id"], r["first_leg"]) for r in got] == [(1, 0), (2, 0), (3, 2)]


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(T.normalize_text, "a ![p](q) [t](u)\r\n\n\n\n  b\x1c \rc ") == "a  t\n\nb\nc"
    assert one(lambda c: T.spread_sample(c, 10, 5), "ab") == "\n...\n".join(["ab"] * 5)
    assert one(T.strip_note, "（提示：原文共 12 字符，数量过多，x）\nrest") == "rest"
    assert one(T.suffix, "/a/.bashrc") == "" and one(T.suffix, "/a.b/C.TXT") == ".txt" and one(T.suffix, "/a.b/c") == ""
    assert one(T.looks_complete, "done.」 \n") and not one(T.looks_complete, "not")
    assert one(T.xml_escape, "<a&b>") == "&lt;a&amp;b&gt;"
    assert one(lambda c: T.under(c, "/a/b"), "/a/bc") is False


def test_names_of_reports(spark):
    import hashlib

    r = spark.range(1).select(T.report_tag(F.lit("/a/b")).alias("one"), T.report_tag_all(F.lit("/x.db")).alias("all")).first()
    assert r == (f"b_{hashlib.sha256(b'/a/b').hexdigest()[:8]}", f"全库_{hashlib.sha256(b'/x.db').hexdigest()[:8]}")


def test_classification(spark):
    cases = [("a.docx", "504B0304", "document"), ("a.apk", "504B0304", "executable"), ("a.zip", "504B0304", "archive"), ("a.webp", "52494646", "media"), ("a.msi", "D0CF11E0", "document"), ("a.txt", "4D5A", "executable"), ("a", "", "unknown"), ("a.csv", "", "data")]
    got = spark.createDataFrame(cases, "p string, h string, w string").select("w", classify(F.col("p"), F.col("h"))["basic_type"].alias("g")).collect()
    assert all(r["g"] == r["w"] for r in got)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_extractors(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xlsx = zipped({"xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
    sml = '<?xml version="1.0"?><Workbook xmlns="urn:x" xmlns:ss="urn:y"><Worksheet ss:Name="T"><Table><Row><Cell><Data>a & b</Data></Cell></Row></Table></Worksheet></Workbook>'.encode()
    files = [("a.txt", "﻿hi ".encode()), ("b.csv", b"a, b\n,\nc,d\n"), ("c.json", '{"k":"é"}'.encode()), ("d.html", b"<title>T</title><script>x</script><p>a&amp;b</p><!-- c -->"), ("e.docx", docx), ("f.xlsx", xlsx), ("g.xls", sml), ("h.bin", b"x"), ("i.json", b"{"), ("j.txt", b" \n"), ("k.txt", "中文".encode("gb18030"))]
    got = {r["path"]: r for r in extract.extract(spark.createDataFrame(files, "path string, content binary")).collect()}
    text = {k: v["full_text"] for k, v in got.items()}
    assert text["a.txt"] == "hi" and text["b.csv"] == "a\tb\nc\td" and text["c.json"] == '{\n"k": "é"\n}' and text["k.txt"] == "中文"
    assert text["d.html"] == "T\na&b" and text["e.docx"] == "Hello\na\tb" and text["f.xlsx"] == "[sheet: S]\nk\t\t3" and text["g.xls"] == "[sheet: T]\na & b"
    assert {k: v["status"] for k, v in got.items() if k in ("h.bin", "i.json", "j.txt")} == {"h.bin": "unsupported", "i.json": "error", "j.txt": "no_text"}


def test_index_search_tag_refresh(spark, tmp_path):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    (src / "proj").mkdir(parents=True)
    (src / "node_modules").mkdir()
    for name, body in {"a.txt": "the licence of apples is a long enough sentence about apples", "b.txt": "bananas and apples are fruit, and this is a sentence", "b2.txt": "bananas and apples are fruit, and this is a sentence", "c.bin": "x", "t.csv": "k,v\n1,2\n", "proj/README.md": "a project", "proj/package.json": "{\"name\": \"p\"}", "proj/code.py": "print(1)", "node_modules/y.js": "no", ".hidden": "no"}.items():
        (src / name).write_text(body)
    stats = engine.build_index(db, str(src))
    assert (stats["scanned"], stats["success"], stats["project_count"], stats["removed"]) == (5, 4, 1, 0)
    assert engine.search_documents(db, "apples licence").first()["path"].endswith("/a.txt")
    assert engine.tag(db)["basic"] == 1
    assert engine.tags_report(db).count() == 6
    assert {r["path"].rsplit("/", 1)[1]: r["keep"] for r in engine.find_duplicates(db, str(src)).collect()}.keys() == {"b.txt", "b2.txt"}
    (src / "b2.txt").unlink()
    again = engine.build_index(db, str(src))
    assert (again["skipped_unchanged"], again["removed"]) == (3, 1)
    assert json.loads(db.read("index_runs").orderBy(F.col("id").desc()).first()["stats_json"])["scanned"] == 4
    assert [r["status"] for r in engine.refresh(db, [str(src), str(tmp_path / "gone")])][0] == "ok"


def test_refresh_stream_sees_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a")
    seen = []
    run = lambda: refresh.refresh_stream(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, _: seen.extend(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect()))
    run()
    (tmp_path / "in/b.txt").write_text("b")
    run()
    assert sorted(seen) == ["a.txt", "b.txt"]


def test_throttle_is_greedy(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 1799, 1800, 3000, 3600])], "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["accepted"] for r in refresh.throttle(rows, "user_id", "ts").orderBy("event_id").collect()] == [True, False, True, False, True]


def test_tag_reports_are_whole(spark, tmp_path):
    """A report over more documents than a ranking shows has all of them."""
    ids = list(range(2_500))
    spark.createDataFrame([(i, f"text {i}", "s", "en", 8) for i in ids], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["doc_id"] for r in catalogue.tag_filter_report(spark, str(tmp_path)).collect()) == ids


def test_ranks_in_runs_equal_a_sort(spark):
    """Many equal scores: ranks follow the score, then the id, whatever the number of rows that one task numbers."""
    rows = [(i * 7 % 5003, 0, float(s)) for i, s in enumerate([1] * 2000 + list(range(1500)) + [7] * 1500)]
    leg = spark.createDataFrame(rows, "doc_id long, chunk_index int, score double").repartition(5)
    for ascending in (True, False):
        want = sorted(((s if ascending else -s), d) for d, _, s in rows)
        got = search.ranked(leg, ascending=ascending).orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(len(rows))) and [((r["score"] if ascending else -r["score"]), r["doc_id"]) for r in got] == want
        assert [r["doc_id"] for r in search.ranked(leg, 50, ascending).orderBy("rank").collect()] == [d for _, d in want[:50]]
    assert search.ranked(leg.where("false")).count() == 0


def test_reranker_scores_by_batches(spark):
    rows = spark.createDataFrame([(1, "a  b"), (2, "longer text"), (3, "x")], "doc_id long, text string")
    scored = search.scored_by(rows, "q", lambda: lambda query, texts: [len(query) + len(t) for t in texts])
    assert [(r["doc_id"], r["score"]) for r in search.best(scored, 3.0, 2).collect()] == [(2, 12.0), (1, 4.0)]


def test_catalog_publishes_at_once(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "db"))
    row = lambda i: spark.createDataFrame([(i, "en", None)], "id long, name string, created_at timestamp")
    db.write("tags", row(1))
    assert Catalog(spark, db.root).read("tags").count() == 0 and db.read("tags").count() == 1
    db.publish()
    (tmp_path / "db/manifests/m=0000000002-broken").mkdir()  # a publication that did not end
    again = Catalog(spark, db.root)
    again.write("tags", row(2))
    again.rollback()
    assert again.read("tags").first()["id"] == 1
    again.write("tags", row(3))
    again.publish()
    assert db.read("tags").first()["id"] == 3
    from docloom.operators import catalog

    catalog.clear_tags(db)
    assert Catalog(spark, db.root).read("tags").count() == 0


def test_a_run_that_fails_loses_nothing(spark, tmp_path):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    src.mkdir()
    (src / "a.txt").write_text("a first text that is indexed")

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        engine.build_index(db, str(src), load=broken)
    assert Catalog(spark, db.root).read("documents").count() == 0
    assert [r["ended_at"] for r in Catalog(spark, db.root).read("index_runs").collect()] == [None]
    stats = engine.build_index(Catalog(spark, db.root), str(src))
    assert (stats["success"], stats["chunk_count"]) == (1, 1)
    assert engine.build_index(Catalog(spark, db.root), str(src))["skipped_unchanged"] == 1
    assert sorted(r["ended_at"] is not None for r in Catalog(spark, db.root).read("index_runs").collect()) == [False, True, True]


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    from docloom.sources import files

    plan = files.read_files(spark, str(tmp_path), 5_000).drop("content")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(modificationTime" in plan


def test_search_statistics(spark, tmp_path):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    src.mkdir()
    for i in range(4):
        (src / f"{i}.txt").write_text(f"apples number {i} " + "apples " * i + "and pears are fruit.")
    (src / "gone.txt").write_text("apples that are gone")
    engine.build_index(db, str(src))
    (src / "gone.txt").unlink()
    engine.build_index(db, str(src))
    engine.tag(db)
    rows, stats = engine.search_with_statistics(db, "apples", top_k=2)
    assert rows.count() == 2 and not any("gone" in r["path"] for r in rows.collect())
    assert {k: stats[k] for k in ("chunk_count", "dense_hit_count", "sparse_hit_count", "tag_hit_count", "candidate_pool_size", "document_count")} == {"chunk_count": 4, "dense_hit_count": 4, "sparse_hit_count": 4, "tag_hit_count": 4, "candidate_pool_size": 4, "document_count": 4}
    assert len(stats) == 12 and stats["top1_score"] > 0
    chunks = db.read("chunks").select(F.col("document_id").alias("doc_id"), "chunk_index", "text")
    all_scores = {r["doc_id"]: r["score"] for r in search.keyword_leg(chunks, "apples").collect()}
    kept = search.keyword_leg(chunks.withColumn("ok", F.lit(True)), "apples", F.col("doc_id") != min(all_scores)).collect()
    assert {r["doc_id"]: r["score"] for r in kept} == {d: x for d, x in all_scores.items() if d != min(all_scores)}
    assert engine.search_documents(db, "apples", reranker=lambda: lambda q, texts: [float(len(t)) for t in texts]).first()["path"].endswith("3.txt")
    assert [r["line"].startswith("- ") and "bm25" in r["line"] for r in tagging.report_lines(engine.tags_report(db, "apples")).collect()] == [True] * 4


def test_tagger_gets_two_attempts(spark):
    rows = spark.createDataFrame([(i, f"/{i}.txt", f"text number {i} is long enough to be tagged at all") for i in range(3)] + [(9, "/9.txt", "short")], "document_id long, path string, full_text string").coalesce(1)

    def tagger():
        calls = []

        def run(texts):
            calls.append(len(texts))
            out = []
            for t in texts:
                n = int(t.split()[2])
                out.append(None if n == 2 or (n == 1 and len(calls) == 1) else ("A whole sentence.", [" a ", "a", "", "b"]) if n else ("No end", ["x"]))
            return out

        return run

    got = {r["document_id"]: (r["status"], [t["name"] for t in r["tags"]]) for r in tagging.tag_documents(rows, tagger()).collect()}
    assert got == {0: ("untagged", []), 1: ("tagged", ["a", "b"]), 2: ("untagged", []), 9: ("untagged", [])}


def test_projects_have_the_category_of_the_model(spark):
    rows = spark.createDataFrame([(1, "/p/one", "short"), (2, "/p/two/", "  "), (3, "/p/bad", "x" * 9000)], "document_id long, path string, full_text string").coalesce(1)
    seen = lambda texts: [("why", [f"{len(t)}", " ", t.split("\n")[0]], "" if t.startswith("bad") else " a study ") for t in texts]
    got = {r["document_id"]: (r["status"], [tuple(t) for t in r["tags"]], r["confidence"], r["reasoning"]) for r in tagging.tag_projects(rows, seen).collect()}
    assert got == {1: ("tagged", [("9", 1.0), ("one", 1.0), ("a study", 1.0)], 0.0, "why"), 2: ("tagged", [(f"{4 + len(tagging.NO_SUMMARY)}", 1.0), ("two", 1.0), ("a study", 1.0)], 0.0, "why"), 3: ("untagged", [], 0.0, tagging.PROJECT_FAILED)}
    vectors_, embed = spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<double>"), spark.createDataFrame([("one", [1.0])], "name string, tag_vector array<double>")
    scored = {r["document_id"]: r["confidence"] for r in tagging.scored(tagging.tag_projects(rows, seen), vectors_, embed).collect()}
    assert scored == {1: 0.0, 2: 0.0, 3: 0.0}
    names = tagging.project_words(__import__("pandas").Series(["one\nname: p\ndescription: several words", "two\nother"]))
    assert [x[2] for x in names] == ["package", "project"]


def test_tags_are_scored_by_vectors(spark):
    results = spark.createDataFrame([(1, [("a", 0.5), ("b", 0.5)], 0.5, "tagged", "r"), (2, [("project", 1.0), ("a", 0.5)], 0.5, "tagged", "r"), (3, [], 0.0, "untagged", ""), (4, [("document", 1.0)], 0.0, "basic", "x")], tagging.RESULT)
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<double>")
    embed = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [-1.0, 0.0])], "name string, tag_vector array<double>")
    got = {r["document_id"]: ([(t["name"], round(t["confidence"], 6)) for t in r["tags"]], round(r["confidence"], 6)) for r in tagging.scored(results, vectors_, embed).collect()}
    assert got == {1: ([("a", 0.6), ("b", 0.0)], 0.3), 2: ([("project", 1.0), ("a", 0.5)], 0.75), 3: ([], 0.0), 4: ([("document", 1.0)], 0.0)}
    names = tagging.clean_tags(spark.createDataFrame([(1, [(" x ", 0.1), ("y", 0.2), ("x", 0.9), (" ", 1.0)], 0.0, "tagged", "")], tagging.RESULT))
    assert sorted((r["name"], r["confidence"], r["at"]) for r in names.collect()) == [("x", 0.9, 0), ("y", 0.2, 1)]


def test_refresh_is_throttled_logged_and_gated(spark, tmp_path):
    src, db = tmp_path / "src", Catalog(spark, str(tmp_path / "db"))
    src.mkdir()
    (src / "a.txt").write_text("a text that is long enough to be tagged by the tagger")
    (src / "b.bin").write_text("x")
    first = engine.refresh(db, [str(src), str(tmp_path / "gone")], healthy=lambda: False)
    assert [x["status"][:5] for x in first] == ["ok", "error"] and first[-1]["pending"] == 1
    assert {r["status"]: r["n"] for r in tagging.status_counts(db.read("tagging_results")).collect()} == {"basic": 1}
    assert [x["status"] for x in engine.refresh(db, [str(src)], min_gap_s=3600)] == ["throttled"]
    assert sorted(r["status"][:5] for r in db.read("refresh_runs").collect()) == ["error", "ok"]
    assert db.read("tagging_results").where("status = 'tagged'").count() == 1
    db.write("refresh_runs", engine.refresh_row(db, str(src), "running", False))
    db.publish()
    assert [x["status"] for x in engine.refresh(db, [str(src)])] == ["busy"]
    assert [x["status"] for x in engine.refresh(db, [str(src)], busy_s=0)] == ["ok"]


def test_cleanup_log_and_trash(spark, tmp_path):
    src, db, log = tmp_path / "src", Catalog(spark, str(tmp_path / "db")), str(tmp_path / "log")
    src.mkdir()
    for name in ("a.txt", "longer.txt", "longest-name.txt", "other.txt"):
        (src / name).write_text("same contents" if name != "other.txt" else "other content")
    plan = engine.plan_cleanup(db, str(src), log).collect()
    assert len(plan) == 2 and {r["kept_path"].rsplit("/", 1)[1] for r in plan} <= {"a.txt", "longer.txt", "longest-name.txt"}
    skip = spark.createDataFrame([(plan[0]["sha256"], "skip")], "sha256 string, action string")
    assert engine.plan_cleanup(db, str(src), str(tmp_path / "log2"), skip).count() == 0
    (tmp_path / "trash").mkdir()
    gone = plan[0]["deleted_path"]
    (tmp_path / "trash/x").write_text("same contents")
    (src / gone.rsplit("/", 1)[1]).unlink()
    with open(tmp_path / "log/more.json", "w") as f:
        f.write("\n  \nnot json\n")
    got = {r["restore_to"]: r["status"] for r in engine.plan_undo(db, log, [str(tmp_path / "trash")], str(src)).collect()}
    assert got == {gone: "restore", plan[1]["deleted_path"]: "occupied"}
    back = spark.createDataFrame([(None, plan[0]["sha256"], None, None, None, gone)], duplicates.LOG)
    duplicates.append_log(back, log)
    assert {r["restore_to"] for r in engine.plan_undo(db, log, [str(tmp_path / "trash")], str(src)).collect()} == {plan[1]["deleted_path"]}
    lines = [r["line"] for r in duplicates.report_lines(engine.find_duplicates(db, str(src))).collect()]
    assert lines[0].startswith("- keep: ") and lines[1].startswith("- duplicate: ") and len(lines) == 2


def test_extraction_limits_and_entities(spark):
    import time

    from docloom.functions.classify import load_rules

    sml = "<?xml version='1.0'?><Workbook xmlns:ss='urn:y'><Worksheet ss:Name='T'><Table><Row><Cell><Data>A&B; x &amp; y &#65;</Data></Cell></Row></Table></Worksheet></Workbook>".encode()
    got = extract.extract(spark.createDataFrame([("a.xls", sml)], "path string, content binary")).first()
    assert (got["full_text"], got["extractor_name"]) == ("[sheet: T]\nA&B; x & y A", "xml-SpreadsheetML")
    slow = {".txt": ("slow", lambda raw: time.sleep(20) or "x")}
    row = extract.extract(spark.createDataFrame([("a.txt", b"x")], "path string, content binary"), 0.2, slow).first()
    assert row["status"] == "error" and row["error"].startswith("TimeoutError")
    import re

    stuck = {".txt": ("stuck", lambda raw: re.match(r"(a+)+$", "a" * 60 + "b") or "x"), ".md": ("gone", lambda raw: __import__("os")._exit(3)), ".log": ("plain", extract.decode)}
    began = time.time()
    files_ = spark.createDataFrame([(f"{i}.{x}", b"text") for i, x in enumerate(("txt", "log", "md", "log", "txt"))], "path string, content binary").coalesce(1)
    ended = [(r["status"], (r["error"] or "").split(":")[0], r["full_text"]) for r in extract.extract(files_, 1.0, stuck).orderBy("path").collect()]
    assert ended == [("error", "TimeoutError", ""), ("success", "", "text"), ("error", "ChildProcessError", ""), ("success", "", "text"), ("error", "TimeoutError", "")] and time.time() - began < 30
    assert callable(load_rules)


def test_rules_from_a_file(tmp_path):
    from docloom.functions.classify import load_rules

    (tmp_path / "r.json").write_text(json.dumps([{"type": "book", "extensions": [".EPUB"], "signatures": ["504b0304"]}]))
    assert load_rules(str(tmp_path / "r.json")) == (("book", (".epub",), ("504B0304",)),)
    (tmp_path / "bad.json").write_text(json.dumps([{"type": "", "extensions": []}]))
    with pytest.raises(ValueError):
        load_rules(str(tmp_path / "bad.json"))


def test_throttle_keeps_repeated_rows_and_names_in_order(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 5), (3, 1, 1800), (3, 2, 1)], "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["event_id"], r["user_id"] or 0, r["accepted"]) for r in refresh.throttle(rows, "user_id", "ts").collect())
    assert got == [(1, 1, False), (1, 1, True), (2, 0, True), (3, 1, True), (3, 2, True)]
    from docloom.operators import catalog

    known = spark.createDataFrame([(7, "en")], "id long, name string")
    names = spark.createDataFrame([(n,) for n in ["b", "aa", "ab2", "ab1", "", "en", "zz", "b"]], "name string")
    assert sorted((r["id"], r["name"]) for r in catalog.with_ids(known, names).collect()) == [(7, "en"), (8, "aa"), (9, "ab1"), (10, "ab2"), (11, "b"), (12, "zz")]


def test_throttle_of_a_stream(spark, tmp_path):
    rows = [(1, 1, 0), (2, 1, 1000), (3, 1, 1800), (4, 2, 5)]
    spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    kept = []
    refresh.throttle_stream(stream, "user_id", "ts").writeStream.foreachBatch(lambda df, _: kept.extend(r["event_id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(kept) == [1, 3, 4]
