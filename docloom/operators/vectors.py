"""Document vectors and tag confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pool_vectors(chunks: DataFrame) -> DataFrame:
    """(doc_id, vector): the mean of (doc_id, vector, weight), weighted (evenly if all weights are zero), of unit length.

    Sums are per place of the vector, before and after the shuffle, so that no document is gathered whole.
    """
    each = chunks.select("doc_id", F.col("weight").cast("double").alias("w"), F.posexplode("vector").alias("at", "v"))
    sums = each.groupBy("doc_id", "at").agg(F.sum(F.col("w") * F.col("v").cast("double")).alias("wv"), F.sum("w").alias("w"), F.sum(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    mean = F.when(F.col("w") == 0, F.col("v") / F.col("n")).otherwise(F.col("wv") / F.nullif("w", F.lit(0.0)))
    whole = sums.select("doc_id", "at", mean.alias("m")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("s"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return whole.select("doc_id", F.transform("s", lambda x: F.when(F.col("norm") == 0, x["m"]).otherwise(x["m"] / F.nullif(F.col("norm"), F.lit(0.0)))).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tag_confidence(tags: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, name, confidence, *keep) for tags (doc_id, name, tag_vector) and docs (doc_id, vector): clipped dot products, 0.5 without a vector."""
    joined = tags.join(docs, "doc_id", "left")
    return joined.select("doc_id", "name", F.when(F.col("vector").isNull(), 0.5).otherwise(F.least(F.greatest(dot(F.col("tag_vector"), F.col("vector")), F.lit(0.0)), F.lit(1.0))).alias("confidence"), *keep)


def document_vectors(chunks: DataFrame, embeddings: DataFrame, model_id: int) -> DataFrame:
    """(doc_id, vector): the chunks' vectors under a model, weighted by the lengths of the chunks; present or not."""
    rows = chunks.join(embeddings.where(F.col("model_id") == model_id).select("document_id", "chunk_index", "vector"), ["document_id", "chunk_index"])
    return pool_vectors(rows.select(F.col("document_id").alias("doc_id"), "vector", F.length("text").alias("weight")))
