"""Hybrid search: cosine over chunk vectors, phrase BM25 over text and tags, rank fusion, thresholded rerank."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docloom.functions.text import compact_text
from docloom.operators.tables import Write, written

RRF_K = 60
CANDIDATES = 80
TOP_K = 5
FLOOR = -2.5
K1, B = 1.2, 0.75
TAG_HIT = "[标签命中] "
PART = re.compile(r'"([^"]*)"|([A-Za-z0-9_\u0080-\U0010ffff\x1a]+)')


@dataclass
class Phrases:
    """A text query: alternatives (or) of conditions that must hold (and), each a group of phrases less excluded groups."""

    any_of: list[list[tuple[list[str], list[list[str]]]]] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        """The phrases that count for the score."""
        return list(dict.fromkeys(p for option in self.any_of for group, _ in option for p in group))

    @property
    def named(self) -> list[str]:
        """All phrases, those that must be absent included."""
        return list(dict.fromkeys([*self.all, *(p for option in self.any_of for _, out in option for x in out for p in x)]))


def parse(query: str) -> Phrases | None:
    """Words and quoted phrases, with AND, OR and NOT; a phrase under three characters has no trigram.

    None for a query that full-text search rejects; such a query finds nothing.
    """
    parts: list[tuple[str, bool]] = []
    at = 0
    for m in PART.finditer(query):
        if query[at : m.start()].strip():
            return None
        parts.append((m[1] if m[1] is not None else m[2], m[1] is not None))
        at = m.end()
    if query[at:].strip() or not parts:
        return None
    options: list[list[tuple[list[str], list[list[str]]]]] = [[([], [])]]
    target = options[0][0][0]
    counts = [0]
    for word, quoted in parts:
        if not quoted and word in ("AND", "OR", "NOT"):
            if not counts[-1]:
                return None
            counts.append(0)
            if word == "OR":
                options.append([([], [])])
                target = options[-1][-1][0]
            elif word == "AND":
                options[-1].append(([], []))
                target = options[-1][-1][0]
            else:
                options[-1][-1][1].append([])
                target = options[-1][-1][1][-1]
        else:
            counts[-1] += 1
            if len(word) >= 3:
                target.append(word.lower())
    if not counts[-1]:
        return None
    # an alternative that asks for what it excludes finds nothing
    possible = lambda o: not any(x and set(x) <= {p for group, _ in o for p in group} for _, out in o for x in out)
    return Phrases([o for o in options if all(group for group, _ in o) and possible(o)])


def has(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(text), F.lit(phrase))


def matches(query: Phrases, held: Callable[[str], Column]) -> Column:
    """Whether a text that holds some phrases is found."""
    every = lambda group: _all([held(p) for p in group])
    return _any([_all([every(g) & ~_any([every(x) for x in out if x]) for g, out in option]) for option in query.any_of])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: Places at which the scores of a leg are cut into runs that are numbered apart.
RUNS = 64


#: Rows (of a few numbers each) up to which one task numbers all of them.
RANK_ROWS = 100_000


def trigrams(text: Column) -> Column:
    """The trigrams of a text, which are its length in scores."""
    return F.greatest(F.length(text) - 2, F.lit(0))


def weights(n: int, containing: list[int]) -> list[float]:
    """The weight of each phrase, of n texts of which so many contain it."""
    return [max(math.log((n - c + 0.5) / (c + 0.5)), 1e-6) for c in containing]


def score(counts: list[Column], size: Column, n: int, mean: float, containing: list[int]) -> Column:
    """BM25 (lower is better) of a text of so many trigrams that has each phrase so many times."""
    out = F.lit(0.0)
    for f, w in zip(counts, weights(n, containing), strict=True):
        out = out - F.lit(w) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / (mean or 1.0)))
    return out


def bm25(rows: DataFrame, query: Phrases, text: str = "text", write: Write = written) -> tuple[DataFrame, int]:
    """rows that match, without their text, with ``bm25`` (lower is better), and how many they are.

    One pass over the texts: it observes the statistics of all rows while the hits, with their counts of each phrase, are written.
    """
    phrases, every, of = query.all, query.named, F.col(text)
    seen, found = Observation(), Observation()
    tested = rows.withColumns({f"_h{i}": has(of, p) for i, p in enumerate(every)} | {"_size": trigrams(of)})
    observed = tested.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size"), *[F.sum(F.col(f"_h{every.index(p)}").cast("long")).alias(f"p{i}") for i, p in enumerate(phrases)])
    counts = [F.regexp_count(F.lower(of), F.lit(f"(?={re.escape(p)})")).cast("double").alias(f"_f{i}") for i, p in enumerate(phrases)]
    others = [c for c in rows.columns if c != text]
    hits = write(observed.where(matches(query, lambda p: F.col(f"_h{every.index(p)}"))).select(*others, "_size", *counts).observe(found, F.count(F.lit(1)).alias("n")))
    stats = seen.get
    n = stats["n"]
    value = score([F.col(f"_f{i}") for i in range(len(phrases))], F.col("_size"), n, (stats["size"] or 0) / max(n, 1), [stats[f"p{i}"] or 0 for i in range(len(phrases))])
    return hits.select(*others, value.alias("bm25")), found.get["n"]


def keyword_leg(chunks: DataFrame, query: str, present: Column | None = None, most: int | None = None, write: Write = written) -> DataFrame:
    """(doc_id, chunk_index, score, rank): the best chunk of each document by BM25, then ranks.

    Statistics cover all chunks; ``present`` leaves out hits afterwards, as a filter of the results does.
    """
    parsed = parse(query)
    if parsed is None or not parsed.any_of:
        return chunks.select("doc_id", "chunk_index", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    return best_chunks(*bm25(chunks, parsed, write=write), present, most)


def best_chunks(hits: DataFrame, n: int, present: Column | None = None, most: int | None = None) -> DataFrame:
    """The best chunk of each document of n written hits (doc_id, chunk_index, bm25), ranked."""
    hits = hits if present is None else hits.where(present)
    best = hits.groupBy("doc_id").agg(F.min(F.struct("bm25", "chunk_index")).alias("b")).select("doc_id", "b.chunk_index", F.col("b.bm25").alias("score"))
    return ranked(best, most, few=n <= RANK_ROWS)


def tag_leg(tags: DataFrame, query: str, most: int | None = None, write: Write = written) -> DataFrame:
    """The same over (doc_id, tags_text); the chunk_index of a tag hit is -1."""
    return keyword_leg(tags.select("doc_id", F.lit(-1).alias("chunk_index"), F.col("tags_text").alias("text")), query, most=most, write=write)


def tag_matches(tags: DataFrame, query: str) -> DataFrame:
    """(doc_id) of all documents whose tags match, without ranks and without a cut: a filter for reports."""
    parsed = parse(query)
    if parsed is None or not parsed.any_of:
        return tags.select("doc_id").where("false")
    return tags.where(matches(parsed, lambda p: has(F.col("tags_text"), p))).select("doc_id").distinct()


def similarity(vector: Column, query: list[float], normalized: bool = True) -> Column:
    """Dot product, or cosine, clipped to [0, 1]; a zero norm counts as one."""
    q = F.array(*[F.lit(float(x)) for x in query])
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = total(vector, q)
    if not normalized:
        norm = F.sqrt(total(vector, vector)) * float(sum(x * x for x in query) ** 0.5)
        score = score / F.when(norm == 0, 1.0).otherwise(norm)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def dense_leg(chunks: DataFrame, query: list[float], normalized: bool = True, most: int | None = None, write: Write = written) -> DataFrame:
    """(doc_id, chunk_index, score, rank) over (doc_id, chunk_index, vector)."""
    scored = chunks.select("doc_id", "chunk_index", similarity(F.col("vector"), query, normalized).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("c"))).alias("b")).select("doc_id", (-F.col("b.c")).alias("chunk_index"), "b.score")
    if most is not None:
        return ranked(best, most, ascending=False)
    seen = Observation()
    rows = write(best.observe(seen, F.count(F.lit(1)).alias("n")))
    return ranked(rows, ascending=False, few=seen.get["n"] <= RANK_ROWS)


def ranked(rows: DataFrame, most: int | None = None, ascending: bool = True, few: bool = False) -> DataFrame:
    """rows, written before, with ``rank`` from 0 by ``score``, equal scores by doc_id; all of them, or the first ``most``.

    A few rows (``few``) are numbered by one task, more in runs: of scores between two quantiles, and, where one score is a quantile itself, of ids
    between two quantiles. A run's first rank is the number of rows in the runs before it.
    """
    score = F.col("score") if ascending else -F.col("score")
    whole = F.row_number().over(Window.orderBy(score, "doc_id")) - 1
    if most is not None:
        return rows.orderBy(score, "doc_id").limit(most).withColumn("rank", whole)
    if few:
        return rows.withColumn("rank", whole)
    at = [i / RUNS for i in range(1, RUNS)]
    cuts = rows.agg(F.percentile_approx(score, at, 10_000).alias("s"), F.percentile_approx("doc_id", at, 10_000).alias("d")).first()
    bounds = sorted(set(cuts["s"] or []))
    below = lambda values, c: sum((F.lit(float(v) if isinstance(v, float) else v) < c).cast("int") for v in values) if values else F.lit(0)
    tie = score.isin(bounds) if bounds else F.lit(False)
    run = F.struct((2 * below(bounds, score) + tie.cast("int")).alias("s"), F.when(tie, below(sorted(set(cuts["d"] or [])), F.col("doc_id"))).otherwise(0).alias("d"))  # a tie with a quantile comes after all that is below it
    parts = rows.withColumn("run", run)
    sizes = {(r["run"]["s"], r["run"]["d"]): r["n"] for r in parts.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most RUNS * RUNS rows
    first, total = [], 0
    for key in sorted(sizes):
        first.append((*key, total))
        total += sizes[key]
    offsets = rows.sparkSession.createDataFrame(first or [(0, 0, 0)], "s int, d int, first long").select(F.struct("s", "d").alias("run"), "first")
    own = F.row_number().over(Window.partitionBy("run").orderBy(score, "doc_id")) - 1
    return parts.withColumn("own", own).join(F.broadcast(offsets), "run").withColumn("rank", (F.col("first") + F.col("own")).cast("int")).drop("run", "own", "first")


def at_once(*legs: Callable[[], DataFrame]) -> list[DataFrame]:
    """The legs of a search, whose jobs run at the same time."""
    with ThreadPoolExecutor(len(legs)) as threads:
        return [x.result() for x in [threads.submit(leg) for leg in legs]]


def fuse(*legs: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: (doc_id, chunk_index, rrf, first_leg, first_rank); the first leg of a document shows."""
    both = None
    for i, leg in enumerate(legs):
        part = leg.select("doc_id", "chunk_index", F.lit(i).alias("leg"), "rank")
        both = part if both is None else both.unionByName(part)
    one = both.groupBy("doc_id").agg(F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("leg", "rank", "chunk_index")).alias("f"))
    return one.select("doc_id", "f.chunk_index", "rrf", F.col("f.leg").alias("first_leg"), F.col("f.rank").alias("first_rank"))


def pool(fused: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    return fused.orderBy(F.col("rrf").desc(), "first_leg", "first_rank", "doc_id").limit(candidates)


def with_text(candidates: DataFrame, chunks: DataFrame, tags: DataFrame, write: Write = written) -> DataFrame:
    """A pool of candidates with the text of the chunk, or of the tags, that shows; the pool is small and is sent to the texts.

    Both are written, so that what is computed of the texts afterwards is computed for the pool alone, not where they are scanned.
    """
    few = F.broadcast(write(candidates))
    plain = chunks.select("doc_id", "chunk_index", "text").join(few.where("chunk_index >= 0"), ["doc_id", "chunk_index"])
    tagged = tags.select("doc_id", F.concat(F.lit(TAG_HIT), "tags_text").alias("text")).join(few.where("chunk_index < 0"), "doc_id")
    return write(plain.unionByName(tagged))


def rerank(candidates: DataFrame, score: Column, floor: float = FLOOR, top_k: int = TOP_K) -> DataFrame:
    """The best candidates of a pairwise score, from a floor up; what is scored is the compacted snippet."""
    scored = candidates.withColumn("snippet", compact_text(F.col("text"))).withColumn("score", score)
    return best(scored, floor, top_k)


def best(scored: DataFrame, floor: float = FLOOR, top_k: int = TOP_K) -> DataFrame:
    return scored.where(F.col("score") >= floor).orderBy(F.col("score").desc(), "doc_id").limit(top_k)


#: Raw scores of a query against texts.
Reranker = Callable[[str, list[str]], list[float]]


def scored_by(candidates: DataFrame, query: str, load: Callable[[], Reranker]) -> DataFrame:
    """candidates with ``snippet`` and ``score`` by a pairwise model that is loaded once a task."""
    rows = candidates.withColumn("snippet", compact_text(F.col("text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in it:
            yield b.assign(score=[float(x) for x in model(query, b["snippet"].tolist())])

    return rows.mapInPandas(batches, f"{schema}, score double")


def lexical_score(query: str, text: str = "snippet") -> Column:
    """The stand-in for a cross-encoder: a logit of the share of query words that a text has."""
    words = list(dict.fromkeys(w for w in re.split(r"\W+", query.lower()) if w))
    share = sum((has(F.col(text), w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    return F.round(F.log((share + 0.01) / (1.01 - share)), 6)


#: Cases of a regression set: what is expected of a query, parts of the first result's path (any), and parts that no result's path may have.
CASES = "query string, expect string, first_has array<string>, none_has array<string>"


def judge(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(query, expect, n_results, first_path, passed) of CASES and the results (query, path, rank) of their queries.

    ``match`` wants results, ``empty`` none; ``note_only`` is not judged.
    """
    has = lambda path, parts: F.exists(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.contains(path, x))
    rows = cases.join(results, "query", "left")
    each = rows.groupBy("query", "expect", "first_has").agg(F.count("path").alias("n_results"), F.min_by("path", "rank").alias("first_path"), F.coalesce(F.bool_or(has(F.col("path"), F.col("none_has"))), F.lit(False)).alias("wrong"))
    right = (F.col("n_results") > 0) & ~F.col("wrong") & ((F.coalesce(F.size("first_has"), F.lit(0)) <= 0) | has(F.col("first_path"), F.col("first_has")))
    passed = F.when(F.col("expect") == "empty", F.col("n_results") == 0).when(F.col("expect") == "match", right)
    return each.select("query", "expect", "n_results", "first_path", passed.alias("passed"))
