"""Models behind small interfaces, with deterministic stand-ins that need no files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Unit vectors of signed word hashes."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed_chunks(chunks: DataFrame, load: Callable[[], Embedder], model_id: int) -> DataFrame:
    """(document_id, chunk_index, model_id, dimension, vector); the model is loaded once a task."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for b in it:
            v = embed(b["text"].tolist())
            yield pd.DataFrame({"document_id": b["document_id"], "chunk_index": b["chunk_index"], "dimension": v.shape[1], "vector": list(v)})

    rows = chunks.select("document_id", "chunk_index", "text").mapInPandas(batches, "document_id long, chunk_index int, dimension int, vector array<float>")
    return rows.withColumn("model_id", F.lit(model_id).cast("long"))
