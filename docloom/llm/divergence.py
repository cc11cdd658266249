"""Source divergence audit: how the use of words in each source of a language departs from the other sources and from the language.

Terms are counted for each (lang, source); a language keeps the terms that at least ``MIN_DOCS`` of its documents have.
Every occurring group is crossed with the kept vocabulary of its language, so that a term that it lacks has the count
zero, and gives each term the smoothed share ``p`` in whole parts of ``SCALE``. The dense rows are joined to themselves on
language and term, which compares each group with each other source of its language; the sums are ranked in windows.
All arithmetic is exact: shares and differences are integers.

Terms are counted where the texts are read: a task sends one row for each group and term of some megabytes of text, so that
a word that a third of all rows have is added up before the shuffle. All counts of one term meet by its hash: as many rows as
its language has sources. Only groups and their totals, one row for each (lang, source), are broadcast, if their measured size
allows. The kept terms are numbered (one number for each language and term) and dealt by number once; both sides of the
self-join are made dense where they lie.

Cases: null text, lang and source are empty strings; a repeated row is a document of its own; a group without terms has the
count zero everywhere; a language without kept terms has the value 0 for all its pairs and no rows of terms; a source that is
alone in its language has no pairs; an empty table gives no rows; other columns are never read. Texts are processed whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded, few, text_bytes, written

#: Documents of a language that a kept term has at least.
MIN_DOCS = 3
#: Parts that make the whole of a group.
SCALE = 1_000_000_000
#: Added to each count.
SMOOTHING = 1
#: Ranks of terms that are reported.
TOP_TERMS = 200
#: A term is a run of ASCII letters and of whatever is not ASCII: other bytes become spaces, A-Z become lower-case.
FOLD = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Entries of a task's counters at which they are sent on.
MOST_ENTRIES = 200_000


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in one or several rows a group and term."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in seen.items():
                terms = list(n)
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([held[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for b in it:
            for text, lang, source in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, held = seen.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(FOLD).split()
                n.update(terms)
                held.update(set(terms))
            if sum(len(n) for n, _ in seen.values()) >= MOST_ENTRIES:
                yield from flush()
        yield from flush()

    rows = bounded(docs).select(text_bytes().alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.mapInArrow(batches, "lang string, source string, term string, n long, docs long")


def groups_of(docs: DataFrame) -> DataFrame:
    """(lang, source, gid): the groups that occur, with terms or without, each with a number of its own."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    return written(rows.withColumn("gid", F.monotonically_increasing_id()))


def kept_terms(counts: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, tid, total, by_group): the vocabulary of each language, numbered, with its occurrences in each group that has it.

    The map has an entry for each source of the language at most.
    """
    rows = counts.join(few(groups), ["lang", "source"]).select("lang", "term", "gid", "n", "docs")
    once = rows.groupBy("lang", "term", "gid").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = once.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("gid", "n"))).alias("by_group"))
    return written(each.where(F.col("docs") >= min_docs).drop("docs").withColumn("tid", F.monotonically_increasing_id()))


def share(n: str, total: str, vocabulary: str) -> Column:
    """The smoothed share of a count in whole parts; decimals, since the product may leave 64 bits."""
    return F.expr(f"1 + (cast({n} + {SMOOTHING} AS decimal(20, 0)) * {SCALE}) div ({total} + {SMOOTHING} * {vocabulary})")


def departure(p: str, q: str) -> Column:
    """The departure of a share p from a share q."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source of the language, ``term`` rows for the terms that a group uses more than its language."""
    named = groups_of(docs)
    kept = kept_terms(count_terms(docs), named, min_docs)
    used = kept.select("lang", "term", "total", F.explode("by_group").alias("gid", "n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("total").alias("lang_total"))
    totals = used.groupBy("gid").agg(F.sum("n").alias("group_total"))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sized = named.join(langs, "lang", "left").join(totals, "gid", "left").select("gid", "lang", "source", number("vocabulary"), number("lang_total"), number("group_total"))
    groups = written(sized.withColumn("least", F.when(F.col("vocabulary") > 0, share("0", "group_total", "vocabulary"))))
    dealt = kept.select("tid", "lang", "by_group").repartition("tid")

    def dense(gid: str, p: str) -> DataFrame:
        """(tid, gid, p) of all kept terms, crossed with all groups of their languages; both uses share one shuffle."""
        rows = dealt.join(few(groups.select("lang", F.col("gid").alias(gid), "vocabulary", "group_total", "least")), "lang").withColumn("n", F.try_element_at("by_group", F.col(gid)))
        return rows.select("tid", gid, F.when(F.col("n").isNull(), F.col("least")).otherwise(share("n", "group_total", "vocabulary")).alias(p))

    both = dense("gid", "p").join(dense("other", "q"), "tid").where("gid <> other")
    sums = both.groupBy("gid", "other").agg(F.sum(departure("p", "q")).alias("value"))
    others = groups.select("lang", "gid", "source").join(groups.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), "lang").where("gid <> other")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = others.join(sums, ["gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(place))
    shares = used.select("term", "total", "gid", "n").join(few(groups), "gid").select("lang", "source", F.col("term").alias("item"), share("n", "group_total", "vocabulary").alias("p"), share("total", "lang_total", "vocabulary").alias("q"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", departure("p", "q").alias("value")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
