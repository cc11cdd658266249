"""Personal data, the filter audit and the divergence of sources: hand-made tables against SQL and plain Python."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.llm import divergence, filter_audit, pii, queries
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, row int, spans string, term string, n long, kind int, failed int, part string"
OPS = ("op11_pii", "op12_filter_audit", "op13_source_divergence")
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (777, 1, 1)]


def documents():
    """Nulls, empty and long texts, ties, repeated rows, copies, edited copies, a hot source, and columns whose names operators use."""
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(None, None, None, None), (1, "", "en", ""), (2, None, "en", "s0"), (3, prose(150), None, "s1"), (3, prose(150), "de", None)]
    rows += [(4, "GREAT News " * 60 + "#$", "en", "s0"), (5, "GREAT News " * 60 + "#$", "fr", "s2"), (5, "GREAT News " * 60 + "#$", "fr", "s2"), (None, "GREAT News " * 60 + "#$", "fr", "s2")]
    rows += [(10 + i, f"{prose(40)} ask Zorblax Quintus or bob@corp.com now {prose(40)} Zorblax again", "en", "s0") for i in range(8)]
    rows += [(30 + i, f"{words[i]} the same rare Xylophon text that other sites took over word for word, write to eve@corp.com for all that it says about old roofs and the tiles on them {words[9 - i]}", "en", "s0") for i in range(8)]
    rows += [(100 + i, "many copies of one text with some words", "en", "s0") for i in range(300)]
    rows += [(500 + i, f"{prose(rng.randrange(5, 300))} é{prose(2)}ü", rng.choice(["en", "de"]), f"s{min(rng.randrange(9), 4)}") for i in range(60)]
    rows += [(600, prose(40_000), "en", "s1"), (601, "a@b.com_x@c.org naïvejohn@x.com 1.2.3.4.5.6.7.8 1.2.3.256 +49 (170) 123-4567. +1 2 4111 1111-1111 1111 4111111111111112 0001.0255.3.4", "ünder", "\x00")]
    return [(d, t, x, s, 1, "x", "y", 2, 3, 4, "z") for d, t, x, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audits"))
    spark.createDataFrame(documents(), SCHEMA).repartition(5).write.parquet(f"{path}/d")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/l")
    import glob
    import shutil

    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{path}/d"), f"{path}/documents.parquet")
    pq.write_table(pq.read_table(f"{path}/l"), f"{path}/labels.parquet")
    for x in glob.glob(f"{path}/[dl]"):
        shutil.rmtree(x)
    return path


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_equal_sql(spark, folder, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], folder)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, folder, name, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_terms_that_give_an_entity_away(spark, folder):
    rows = {r["doc_id"]: r for r in pii.find_personal_data(spark.read.parquet(f"{folder}/documents.parquet")).where("doc_id between 10 and 40").collect()}
    text = {d[0]: d[1] for d in documents() if d[0] is not None}
    for i in range(10, 18):  # by chance, surroundings of one entity may share their least digest
        told = [text[i][s["start"] : s["stop"]] for s in rows[i]["added"]]
        assert told.count("Zorblax") == 2 and told.count("Quintus") == 1
        assert "Zorblax" not in rows[i]["sanitised_text"] and "<EMAIL>" in rows[i]["sanitised_text"] and "bob" not in rows[i]["sanitised_text"]
    for i in range(30, 38):  # edited copies are no evidence
        assert rows[i]["added"] == []
        assert rows[i]["sanitised_text"] == text[i].replace("eve@corp.com", "<EMAIL>")


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(queries.PERSONAL):
        for m in re.finditer(pattern, text):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - (9 if int(c) > 4 else 0)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, x in out)


def test_base_spans_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@.-+0123 4567(89)é\n_%:") for _ in range(rng.randrange(0, 120))) for _ in range(600)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "4111111111111111", "+1 (202) 555-0100", "10.0.0.1", "a.b@c.d", "256.1.1.1", " ", ", ", "x", "-", "."]) for _ in range(12)) for _ in range(300)]
    rows = pii.digests(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        want = brute_spans(texts[r["doc_id"]])
        assert [x for x in r["spans"].split(",") if not x.startswith("term")] == want.split(",")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_long_runs_take_one_pass(spark):
    long = "x" * 1_000_000 + " @ " + "1" * 1_000_000 + " +" + "1 " * 200_000 + ".".join("12" for _ in range(100_000)) + " a@" + ".".join("b" for _ in range(100_000)) + " " + "a@b.c " * 3_000
    began = time.time()
    r = pii.find_personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert time.time() - began < 120
    kinds = [s["kind"] for s in r["base"]]
    assert kinds.count("email") == 3_001 and (kinds.count("ip"), kinds.count("card"), kinds.count("phone")) == (25_000, 0, 0)
    assert r["sanitised_text"].count("<EMAIL>") == 3_001 and "@b" not in r["sanitised_text"]


def test_overlapping_spans_are_replaced_together(spark):
    spans = "array(named_struct('start', 2, 'stop', 5, 'label', '<A>', 'kind', 'a'), named_struct('start', 4, 'stop', 7, 'label', '<B>', 'kind', 'b'), named_struct('start', 5, 'stop', 6, 'label', '<C>', 'kind', 'c'), named_struct('start', 8, 'stop', 9, 'label', '', 'kind', 'd'))"
    assert spark.range(1).select(pii.sanitised(F.lit("é123456789"), F.expr(spans)).alias("t")).first()["t"] == "é1<A>79"


def test_duplicates_across_ranges(spark):
    """One group in many ranges, and texts of one fingerprint side by side."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.concat(F.lit("own "), F.col("id") % 500)).alias("text"), F.lit("en").alias("lang")).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = filter_audit.failures(docs).select("doc_id", F.col("failed").bitwiseAND(filter_audit.DUPLICATE).alias("e")).collect()
        kinds = filter_audit.sorted_failures(docs).groupBy("kind").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["kind"] for r in kinds} == {0, 1, 2} and sum(r["count"] for r in kinds if r["kind"] < 2) == 20_000
    least = {}
    for d in range(20_000):
        least.setdefault("copy" if d % 3 else d % 500, d)
    assert len(rows) == 20_000
    for r in rows:
        d = r["doc_id"]
        assert bool(r["e"]) == (least["copy" if d % 3 else d % 500] < d)


def test_counters_hold_every_document_once(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    counted = filter_audit.counters(filter_audit.failures(docs), labels)
    n = docs.count()
    assert counted.agg(F.sum("n")).first()[0] == n
    rows = filter_audit.interactions(counted).collect()
    for r in (r for r in rows if r["step"] == 5):
        own = [x for x in rows if (x["part"], x["filter_order"]) == (r["part"], r["filter_order"])]
        assert r["kept"] + sum(x["removed"] for x in own) == docs.where(F.coalesce("lang", F.lit("")) == r["part"]).count()


def test_shares_of_very_large_counts(spark):
    r = spark.sql("SELECT 20000000000L AS n, 90000000000L AS t, 7L AS v").select(divergence.share("n", "t", "v").alias("p")).first()
    assert r["p"] == 1 + (20_000_000_001 * 1_000_000_000) // 90_000_000_007
