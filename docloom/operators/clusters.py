"""Exact nearest vectors from clusters: those that cannot hold a better one, by the triangle inequality, are never opened.

Vectors of unit length lie in clusters of centres, each with the distance of its farthest member. With a query at the distance d
of a centre whose radius is r, no member is nearer than d - r, so none scores over 1 - (d - r)² / 2. Clusters are opened in the
order of that bound, twice as many each time, until it falls below the score of the k-th best document found.

Centres are fitted on a sample of at most ``SAMPLE`` vectors, the first by a hash of their keys; every vector is assigned. New vectors go
to the centres there are and widen their radii. Centres and radii, some ``MOST_CENTRES`` rows at most, are the only part that the driver holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import similarity

SAMPLE, MOST_CENTRES, ROUNDS = 20_000, 4096, 8
#: Vectors become this many times as many before centres are fitted anew.
GROWTH = 4
#: What rounding may take from a bound.
SLACK = 1e-5
CENTRES = "cluster int, centre array<double>, radius double, n long"


def fit(vectors: DataFrame, n: int) -> np.ndarray:
    """Centres of n vectors (document_id, chunk_index, vector), about the root of their number."""
    rows = vectors.select("vector").orderBy(F.xxhash64("document_id", "chunk_index"), "document_id", "chunk_index").limit(SAMPLE).collect()
    points = np.array([r[0] for r in rows], np.float64)
    k = max(1, min(MOST_CENTRES, math.isqrt(max(n, 1)), len(points)))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        for c in range(k):
            own = points[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with ``cluster``, the nearest centre, and ``distance`` from it."""
    names, at = vectors.columns, vectors.columns.index("vector")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            points = np.asarray(b.column(at).flatten(), np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
            distance = np.sqrt(((points - centres[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(distance)], [*names, "cluster", "distance"])

    return vectors.mapInArrow(batches, f"{schema}, cluster int, distance double")


def spread(members: DataFrame, centres: np.ndarray, known: dict[int, tuple[float, int]] | None = None) -> DataFrame:
    """CENTRES rows: radius and number of each cluster of written members (cluster, distance), and what was known of it."""
    own = {r["cluster"]: (r["radius"], r["n"]) for r in members.groupBy("cluster").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    both = {c: (max(own.get(c, (0.0, 0))[0], (known or {}).get(c, (0.0, 0))[0]), own.get(c, (0.0, 0))[1] + (known or {}).get(c, (0.0, 0))[1]) for c in range(len(centres))}
    return members.sparkSession.createDataFrame([(c, centres[c].tolist(), *both[c]) for c in range(len(centres))], CENTRES).coalesce(1)


def nearest(members: DataFrame, centres: DataFrame, query: list[float], k: int) -> tuple[DataFrame, dict[str, int]]:
    """(doc_id, chunk_index, score, rank) of the k best documents among members (document_id, chunk_index, cluster, vector), by their best chunk,

    equal scores by doc_id and chunk_index, as ``search.dense_leg`` has them; and how many clusters, and vectors, were opened of how many.
    """
    spark: SparkSession = members.sparkSession
    rows, q = centres.collect(), np.array(query, np.float64)
    length = float(np.linalg.norm(q))
    if rows and length:
        q = q / length
    bounds = []
    for r in rows:
        d = float(np.linalg.norm(q - np.array(r["centre"]))) - r["radius"] if length else 0.0
        bounds.append((min(1.0, (length or 1.0) * (1 - max(0.0, d) ** 2 / 2)), r["cluster"], r["n"]))
    bounds.sort(key=lambda b: (-b[0], b[1]))
    best: list[tuple[float, int, int]] = []
    at, wave = 0, max(1, math.isqrt(len(bounds)))
    while at < len(bounds) and (len(best) < k or max(bounds[at][0], 0.0) >= best[k - 1][0] - SLACK):
        opened = [c for _, c, _ in bounds[at : at + wave]]
        scored = members.where(F.col("cluster").isin(opened)).select(F.col("document_id").alias("doc_id"), "chunk_index", similarity(F.col("vector"), query).alias("score"))
        each = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("c"))).alias("b")).select("doc_id", (-F.col("b.c")).alias("chunk_index"), "b.score")
        top = [(r["score"], r["doc_id"], r["chunk_index"]) for r in each.orderBy(F.col("score").desc(), "doc_id").limit(k).collect()]  # k rows
        of: dict[int, tuple[float, int, int]] = {}
        for x in sorted(best + top, key=lambda x: (-x[0], x[2])):
            of.setdefault(x[1], x)
        best = sorted(of.values(), key=lambda x: (-x[0], x[1]))[:k]
        at, wave = at + wave, wave * 2
    read = bounds[: min(at, len(bounds))]
    out = spark.createDataFrame([(d, c, float(s), i) for i, (s, d, c) in enumerate(best)], "doc_id long, chunk_index int, score double, rank int")
    return out, {"clusters": len(bounds), "clusters_read": len(read), "vectors": sum(b[2] for b in bounds), "vectors_read": sum(b[2] for b in read)}
