"""Tags: what needs tagging, basic tags, validated tags of a pluggable tagger, reports."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SENTENCE_ENDS, basename, snippet, strip, suffix
from docloom.operators.vectors import tag_confidence

MIN_CHARS = 30
NO_EXTENSION = "无扩展名"
BASIC_REASON = "非文档类型或未成功提取文本，仅做基础类型识别，未做语义内容分析"
DEFAULT_CONFIDENCE = 0.5
RESULT = "document_id long, tags array<struct<name:string,confidence:double>>, confidence double, status string, reasoning string"


def pending(documents: DataFrame, extractions: DataFrame, results: DataFrame, projects: bool = False) -> DataFrame:
    """Extracted documents, or projects, that have no result, or one older than their extraction."""
    docs = documents.where("is_present").where(f"basic_type {'=' if projects else '<>'} 'project'").select(F.col("id").alias("document_id"), "path", "basic_type")
    rows = docs.join(extractions.where("status = 'success'").select("document_id", "full_text", F.col("created_at").alias("extracted_at")), "document_id")
    return rows.join(results.select("document_id", F.col("created_at").alias("tagged_at")), "document_id", "left").where("tagged_at is null or extracted_at > tagged_at").drop("tagged_at")


def too_short(rows: DataFrame) -> DataFrame:
    return rows.where(F.length(strip(F.col("full_text"))) < MIN_CHARS)


def long_enough(rows: DataFrame) -> DataFrame:
    return rows.where(F.length(strip(F.col("full_text"))) >= MIN_CHARS)


def basic_tags(documents: DataFrame, extractions: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Results with type and extension for documents without extracted text."""
    rows = documents.where("is_present").join(extractions.where("status = 'success'").select(F.col("document_id").alias("id")), "id", "left_anti")
    if not force:
        rows = rows.join(results.select(F.col("document_id").alias("id")), "id", "left_anti")
    ext = F.substring(suffix(F.col("path")), 2, 1_000)
    tag = lambda c: F.struct(c.alias("name"), F.lit(1.0).alias("confidence"))
    tags = F.array(tag(F.coalesce("basic_type", F.lit("unknown"))), tag(F.when(ext == "", NO_EXTENSION).otherwise(ext)))
    return rows.select(F.col("id").alias("document_id"), tags.alias("tags"), F.lit(0.0).alias("confidence"), F.lit("basic").alias("status"), F.lit(BASIC_REASON).alias("reasoning"))


#: (reason, names) of each text; None where the model failed.
Tagger = Callable[[pd.Series], list[tuple[str, list[str]] | None]]


def frequent_words(texts: pd.Series) -> list[tuple[str, list[str]] | None]:
    """The stand-in for a language model: the most frequent longer words."""
    out = []
    for t in texts:
        counts = Counter(w for w in str(t).lower().split() if len(w) > 4 and w.isalpha())
        top = sorted(counts, key=lambda w: (-counts[w], w))[:3]
        out.append((f"Frequent words: {', '.join(top)}.", top))
    return out


#: Times that a text is given to the tagger before it counts as untagged.
ATTEMPTS = 2


def accepted(result: tuple[str, list[str]] | None) -> tuple[str, list[str]] | None:
    """A result with tags and a whole sentence as its reason."""
    if result is None:
        return None
    reason, names = result
    names = list(dict.fromkeys(n.strip() for n in names if n and n.strip()))
    whole = bool(reason) and reason.rstrip().endswith(tuple(SENTENCE_ENDS))
    return (reason, names) if names and whole else None


EMPTY = "array<struct<name:string,confidence:double>>"


def attempts(rows: DataFrame, tagger: Callable, accept: Callable, text: str, schema: str) -> DataFrame:
    """What is accepted of a tagger over the texts of rows, asked twice for what it fails on; null where it fails again."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            found: list = [None] * len(b)
            for _ in range(ATTEMPTS):
                left = [i for i, x in enumerate(found) if x is None]
                for i, x in zip(left, tagger(b[text].iloc[left]) if left else [], strict=True):
                    found[i] = accept(x)
            columns = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame({"document_id": b["document_id"], **{c: [None if x is None else x[i] for x in found] for i, c in enumerate(columns)}})

    return rows.select("document_id", text).mapInPandas(batches, f"document_id long, {schema}")


def tag_documents(rows: DataFrame, tagger: Tagger = frequent_words) -> DataFrame:
    """Results of a tagger over pending rows; what it fails on twice, and what is too short, is untagged."""
    ready = long_enough(rows).select("document_id", snippet(F.col("full_text"), F.col("path")).alias("snippet"))
    raw = attempts(ready, tagger, accepted, "snippet", "reasoning string, names array<string>")
    tags = F.transform("names", lambda x: F.struct(x.alias("name"), F.lit(DEFAULT_CONFIDENCE).alias("confidence")))
    empty, good = F.array().cast(EMPTY), F.col("names").isNotNull()
    done = raw.select("document_id", F.when(good, tags).otherwise(empty).alias("tags"), F.when(good, DEFAULT_CONFIDENCE).otherwise(0.0).alias("confidence"), F.when(good, "tagged").otherwise("untagged").alias("status"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
    short = too_short(rows).select("document_id", empty.alias("tags"), F.lit(0.0).alias("confidence"), F.lit("untagged").alias("status"), F.lit("").alias("reasoning"))
    return done.unionByName(short)


#: (reason, names, category) of each project's summary; None where the model failed.
ProjectTagger = Callable[[pd.Series], list[tuple[str, list[str], str] | None]]
SUMMARY_CHARS = 2500
#: The text of a project without a summary, and the reason of one that the model fails on.
NO_SUMMARY = "（没有找到 README/CLAUDE.md/package.json 等自描述文件，只能凭项目名字判断）"
PROJECT_FAILED = "项目打标签 SLM 输出解析失败"


def project_words(texts: pd.Series) -> list[tuple[str, list[str], str] | None]:
    """The stand-in for a language model that is asked about projects: frequent words, and whether there is a package."""
    return [(reason, names, "package" if re.search("(?m)^name: ", t) else "project") for t, (reason, names) in zip(texts, frequent_words(texts), strict=True)]


def accepted_project(result: tuple[str, list[str], str] | None) -> tuple[str, list[str], str] | None:
    """A result with a category."""
    if result is None or not (result[2] or "").strip():
        return None
    return (result[0] or "").strip(), [n.strip() for n in result[1] if n and n.strip()], result[2].strip()


def tag_projects(rows: DataFrame, tagger: ProjectTagger = project_words) -> DataFrame:
    """Results over pending projects, by their names and the first ``SUMMARY_CHARS`` of their summaries, however short.

    The tags and, last, the category that the model gives are sure; the result's own confidence is zero.
    """
    summary = F.when(F.trim(F.coalesce("full_text", F.lit(""))) == "", NO_SUMMARY).otherwise(F.substring("full_text", 1, SUMMARY_CHARS))
    ready = rows.select("document_id", F.concat(basename(F.regexp_replace("path", "/+$", "")), F.lit("\n"), summary).alias("summary"))
    raw = attempts(ready, tagger, accepted_project, "summary", "reasoning string, names array<string>, category string")
    sure = lambda c: F.struct(c.alias("name"), F.lit(1.0).alias("confidence"))
    good = F.col("category").isNotNull()
    tags = F.when(good, F.concat(F.transform("names", sure), F.array(sure(F.col("category"))))).otherwise(F.array().cast(EMPTY))
    return raw.select("document_id", tags.alias("tags"), F.lit(0.0).alias("confidence"), F.when(good, "tagged").otherwise("untagged").alias("status"), F.when(good, F.col("reasoning")).otherwise(PROJECT_FAILED).alias("reasoning"))


def scored(results: DataFrame, vectors: DataFrame, embed: DataFrame) -> DataFrame:
    """results with each tag's confidence, its clipped product with the document's vector, and their mean.

    vectors is (doc_id, vector), embed (name, tag_vector). Sure tags (1.0) stay, and so do results with no other tags; without a vector 0.5 counts.
    """
    each = results.where("status = 'tagged'").select("document_id", F.posexplode("tags").alias("at", "t")).select(F.col("document_id").alias("doc_id"), "at", "t.name", "t.confidence")
    open_ = tag_confidence(each.where("confidence < 1").join(embed, "name").select("doc_id", "name", "tag_vector", "at"), vectors, keep=("at",)).withColumn("open", F.lit(True))
    both = open_.unionByName(each.where("confidence = 1").select("doc_id", "name", "confidence", "at", F.lit(False).alias("open")))
    lists = both.groupBy(F.col("doc_id").alias("document_id")).agg(F.sort_array(F.collect_list(F.struct("at", "name", F.col("confidence").alias("c")))).alias("l"), F.avg("confidence").alias("mean"), F.bool_or("open").alias("open"))
    lists = lists.where("open").select("document_id", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["c"].alias("confidence"))).alias("found"), "mean")
    rows = results.join(lists, "document_id", "left")
    return rows.select("document_id", F.coalesce("found", "tags").alias("tags"), F.coalesce("mean", "confidence").alias("confidence"), "status", "reasoning")


def mean_confidence(tags: DataFrame) -> DataFrame:
    return tags.groupBy("doc_id").agg(F.avg("confidence").alias("confidence"))


def clean_tags(results: DataFrame) -> DataFrame:
    """(document_id, name, confidence, at): blank names dropped; of a name that repeats the last confidence counts."""
    each = results.select("document_id", F.posexplode("tags").alias("at", "t")).select("document_id", "at", strip(F.col("t.name")).alias("name"), "t.confidence").where("name <> ''")
    return each.groupBy("document_id", "name").agg(F.max_by("confidence", "at").alias("confidence"), F.min("at").alias("at"))


def tags_text(tags: DataFrame) -> DataFrame:
    """(document_id, tags_text): names in input order, for tag search."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "name")))
    return tags.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " ").alias("tags_text"))


def by_name(tags: DataFrame) -> DataFrame:
    """(document_id, tags) of tags (document_id, name, confidence), in the order of their names."""
    return tags.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("name", F.col("confidence").alias("c")))).alias("tags"))


def tag_report(documents: DataFrame, results: DataFrame, tags: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(document_id, path, status, confidence, reasoning, created_at, tags), newest first; tags in the order of their names.

    only is (document_id), or (document_id, bm25) of a search, whose order then counts.
    """
    rows = results.join(documents.select(F.col("id").alias("document_id"), "path"), "document_id").join(by_name(tags), "document_id", "left")
    if only is not None and "bm25" in only.columns:
        return rows.join(only, "document_id").orderBy("bm25", "document_id")
    rows = rows if only is None else rows.join(only, "document_id", "left_semi")
    return rows.orderBy(F.col("created_at").desc(), "document_id")


#: A mark for each status.
ICONS = {"tagged": "✅", "untagged": "⚪", "basic": "📄"}


def report_lines(rows: DataFrame) -> DataFrame:
    """(document_id, line): the report as Markdown, one item a document; its score is shown where the rows have one."""
    tags = F.array_join(F.transform("tags", lambda t: F.format_string("%s (%.2f)", t["name"], t["c"])), ", ")
    icon = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv]), F.col("status")), F.lit("•"))
    score = [F.format_string("bm25 %.4f", "bm25")] if "bm25" in rows.columns else []
    return rows.select("document_id", F.concat(F.lit("- "), F.concat_ws(" | ", F.concat(icon, F.lit(" "), F.col("path")), F.col("status"), F.format_string("%.2f", "confidence"), *score, tags)).alias("line"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
